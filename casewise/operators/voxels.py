"""Masks as sparse voxel tables (case_id, x, y, z, gt, pred, ts, ...): components, overlaps, lesions and regions.

A row is an occupied voxel; everything else of a case's grid is background, so
means over background and true negatives come from the grid's size. Where a case
is one scan whose voxels fit in one task, component search runs per case on
coordinate arrays; with `tile` it runs per tile of the grid, and labels that meet
across tiles are merged by joins, so a volume may be larger than any task. All
else is grouping and equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.operators.graph import merged
from casewise.operators.ordering import dealt, numbered
from casewise.sources.files import stored

XYZ = ["x", "y", "z"]
#: Volume from which a region counts as high risk, in cubic millimetres.
HIGH_RISK_MM3 = 4180.0
#: Percent of overlap above which a lesion counts as hit.
OVERLAP_PERCENT = 1.0


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbour offsets of 6 (faces), 18 (and edges) or 26 (and corners) connectivity."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most]


def _labels(c: np.ndarray, half: list[tuple[int, int, int]], region: np.ndarray | None = None) -> np.ndarray:
    """Component numbers, from 1, of points (rows x, y, z); neighbours of different regions don't connect."""
    low = c.min(axis=1) - 1
    sx, sy = (c.max(axis=1) - low + 2)[:2]
    key = ((c[2] - low[2]) * sy + (c[1] - low[1])) * sx + (c[0] - low[0])
    order = np.argsort(key)
    ordered, a, b = key[order], [], []
    for dx, dy, dz in half:
        want = ordered + (dz * sy + dy) * sx + dx
        at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
        near = ordered[at] == want
        if region is not None:
            near &= region[order][at] == region[order]
        hit = np.flatnonzero(near)
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(ordered))
    while True:
        new = root.copy()
        np.minimum.at(new, root[a], root[b])
        np.minimum.at(new, root[b], root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    comp = np.empty(len(ordered), np.int32)
    comp[order] = np.unique(root, return_inverse=True)[1] + 1
    return comp


#: Coordinates within this of 0 fit the whole number that names a voxel.
FAR = 1 << 20


def voxel_key(z: Column, y: Column, x: Column) -> Column:
    """One whole number per voxel, in order of (z, y, x)."""
    part = lambda c, bits: F.shiftleft((c + FAR).cast("long"), bits)
    return F.shiftleft((z + FAR).cast("long"), 42) + part(y, 21) + part(x, 0)


def connected_components(vox: DataFrame, mask: str, connectivity: int = 18, by: tuple[str, ...] = ("case_id",), tile: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """`by`, x, y, z, comp and `carry` of the voxels whose mask is above 0; comp numbers from 1 in order of the first voxel by (z, y, x).

    Without `tile` a group's voxels are one task's; with it a task has those of a
    cube of that many voxels a side.
    """
    if tile:
        return _tiled(vox.where(F.col(mask) > 0).select(*by, *XYZ, *carry), connectivity, by, tile)
    half = [o for o in offsets(connectivity) if o[::-1] > (0, 0, 0)]
    rows = vox.where(F.col(mask) > 0).select(*by, *XYZ, *carry)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", comp int"

    def label(t: pa.Table) -> pa.Table:
        c = np.asarray([t.column(k).to_numpy() for k in XYZ], np.int64)
        return t.append_column("comp", pa.array(_labels(c, half), pa.int32()))

    return rows.groupBy(*by).applyInArrow(label, schema)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Which rows begin a group, in a table sorted by keys; nulls are one group."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, many where they are small, from batches sorted by keys; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = held and not _starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)[1]
        starts = np.flatnonzero(_starts(pa.Table.from_batches([batch]), keys))
        cut = int(starts[-1])
        if same and not cut:  # all of it belongs to the group that waits
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def label_tiles(t: pa.Table, keys: list[str], tile: int, half: list[tuple[int, int, int]]) -> pa.Table:
    """Adds _label, the least _key of each voxel's component within its tile; tiles stand one behind the other with a gap, so one search labels all."""
    c = np.asarray([t.column(k).to_numpy() for k in XYZ], np.int64)
    if np.abs(c).max() >= FAR:
        raise ValueError(f"coordinates of {FAR} and more have no voxel key")
    c %= tile
    c[2] += (np.cumsum(_starts(t, keys)) - 1) * (tile + 1)
    key, comp = t.column("_key").to_numpy(), _labels(c, half) - 1
    first = np.full(comp.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, comp, key)
    return t.append_column("_label", pa.array(first[comp], pa.int64()))


def _tiled(rows: DataFrame, connectivity: int, by: tuple[str, ...], tile: int) -> DataFrame:
    """Components by tiles: each tile is labelled on its own, a label being the first voxel's key; voxels on either side of a border give edges between labels, which merge by rounds of joins."""
    half = [o for o in offsets(connectivity) if o[::-1] > (0, 0, 0)]
    names = rows.columns
    tiles = {f"_t{k}": F.floor(F.col(k) / tile).cast("int") for k in XYZ}
    rows = rows.withColumns({"_key": voxel_key(F.col("z"), F.col("y"), F.col("x")), **tiles})
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", _label long"

    keys = [*by, *tiles]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            yield from label_tiles(t, keys, tile, half).to_batches()

    labelled = stored(dealt(rows, *keys).sortWithinPartitions(*keys).mapInArrow(label, schema), "labels")
    at = {k: F.pmod(F.col(k), F.lit(tile)) for k in XYZ}
    edge = F.lit(False)
    for k in XYZ:
        edge = edge | (at[k] == 0) | (at[k] == tile - 1)
    border = labelled.where(edge)
    across = []
    for o in half:
        away = F.lit(False)
        for k, d in zip(XYZ, o, strict=True):
            away = away | ((at[k] == 0) if d < 0 else (at[k] == tile - 1) if d > 0 else F.lit(False))
        across.append(F.when(away, F.struct(*[(F.col(k) + d).alias(k) for k, d in zip(XYZ, o, strict=True)])))
    want = border.select(*by, F.col("_label").alias("_a"), F.explode(F.array_compact(F.array(*across))).alias("_p")).select(*by, "_a", voxel_key(F.col("_p.z"), F.col("_p.y"), F.col("_p.x")).alias("_key"))
    edges = want.join(border.select(*by, "_key", F.col("_label").alias("_b")), [*by, "_key"])
    roots = stored(merged(edges, "_a", "_b", by).withColumnsRenamed({"label": "_label", "root": "_root"}), "roots")
    labels = labelled.select(*by, "_label").distinct().join(roots, [*by, "_label"], "left").withColumn("_root", F.coalesce("_root", "_label"))
    firsts = numbered(labels.where("_root = _label").select(*by, "_root"), "_root", ["_root"], "_comp", by=by)
    comps = labels.join(firsts, [*by, "_root"]).select(*by, "_label", F.col("_comp").cast("int").alias("comp"))
    return labelled.join(comps, [*by, "_label"]).select(*names, "comp")


def with_components(vox: DataFrame, masks: dict[str, str], connectivity: int = 18) -> DataFrame:
    """All voxels and columns, and for each mask a column of the given name with its component's number, null off the mask; one call per case."""
    half = [o for o in offsets(connectivity) if o[::-1] > (0, 0, 0)]
    schema = ", ".join(f"`{n}` {t}" for n, t in vox.dtypes) + "".join(f", {n} int" for n in masks.values())

    def label(t: pa.Table) -> pa.Table:
        c = np.asarray([t.column(k).to_numpy() for k in XYZ], np.int64)
        for mask, name in masks.items():
            at, comp = np.flatnonzero(np.nan_to_num(t.column(mask).to_numpy()) > 0), np.zeros(t.num_rows, np.int32)
            if len(at):
                comp[at] = _labels(c[:, at], half)
            t = t.append_column(name, pa.array(comp, pa.int32(), mask=comp == 0))
        return t

    return vox.groupBy("case_id").applyInArrow(label, schema)


def confusion_counts(vox: DataFrame, grid: int, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    g, p = F.col("gt") > 0, F.col("pred") > 0
    out = vox.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return out.withColumn("tn", F.lit(grid) - F.col("tp") - F.col("fp") - F.col("fn"))


def dice(tp: Column, fp: Column, fn: Column, empty: float | None = None) -> Column:
    """2 TP / (2 TP + FP + FN); `empty` (0, 1 or null) where both masks are empty."""
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(empty).cast("double"))


def component_counts(vox: DataFrame, pairs: tuple[tuple[str, str], ...], connectivity: int = 18, within: str | None = None) -> DataFrame:
    """case_id, `within`, mask, n_components, n_unmatched, unmatched_voxels for each (mask, other) of `pairs`.

    Unmatched is a component that no voxel of `other` touches. With `within` (a
    column of whole numbers such as the region) masks are cut by it before
    components are formed. One pass and one call per case, whatever the number
    of masks and regions; groups without a component have no row.
    """
    half = [o for o in offsets(connectivity) if o[::-1] > (0, 0, 0)]
    masks = sorted({m for p in pairs for m in p})
    region = F.col(within) if within else F.lit(0)
    rows = vox.select("case_id", *XYZ, region.cast("long").alias("region"), *[F.coalesce(F.col(m) > 0, F.lit(False)).alias(m) for m in masks])

    def count(t: pa.Table) -> pa.Table:
        c = np.asarray([t.column(k).to_numpy() for k in XYZ], np.int64)
        names, region = np.unique(t.column("region").to_numpy(), return_inverse=True)
        has = {m: t.column(m).to_numpy().astype(bool) for m in masks}
        out: dict = {k: [] for k in ("region", "mask", "n_components", "n_unmatched", "unmatched_voxels")}
        for mask, other in pairs:
            at = np.flatnonzero(has[mask])
            if not len(at):
                continue
            comp = _labels(c[:, at], half, region[at]) - 1
            size, hits, place = np.bincount(comp), np.bincount(comp, has[other][at]), np.empty(comp.max() + 1, np.int64)
            place[comp] = region[at]
            n, free = np.bincount(place, minlength=len(names)), hits == 0
            some = np.flatnonzero(n)
            out["region"] += names[some].tolist()
            out["mask"] += [mask] * len(some)
            out["n_components"] += n[some].tolist()
            out["n_unmatched"] += np.bincount(place, free, len(names))[some].astype(np.int64).tolist()
            out["unmatched_voxels"] += np.bincount(place, free * size, len(names))[some].astype(np.int64).tolist()
        case = t.column("case_id").combine_chunks()[:1].take(pa.array([0] * len(out["mask"]), pa.int32()))
        kinds = {"mask": pa.string()}
        return pa.table({"case_id": case} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    schema = f"case_id {dict(vox.dtypes)['case_id']}, region long, mask string, n_components long, n_unmatched long, unmatched_voxels long"
    found = rows.groupBy("case_id").applyInArrow(count, schema)
    if not within:
        return found.drop("region")
    return found.withColumn("region", F.col("region").cast(dict(vox.dtypes)[within])).withColumnRenamed("region", within)


def unmatched_components(vox: DataFrame, mask: str, other: str, connectivity: int = 18, within: str | None = None, tile: int | None = None) -> DataFrame:
    """case_id, `within`, n_components, n_unmatched, unmatched_voxels: components of `mask` that no voxel of `other` touches; with `tile` by tiles of the grid."""
    if not tile:
        return component_counts(vox, ((mask, other),), connectivity, within).drop("mask")
    by = ("case_id", *([within] if within else []))
    found = connected_components(vox.withColumn("_hit", F.coalesce(F.col(other) > 0, F.lit(False))), mask, connectivity, by, tile, ("_hit",))
    per = found.groupBy(*by, "comp").agg(F.count("*").alias("n"), F.bool_or("_hit").alias("hit"))
    return per.groupBy(*by).agg(F.count("*").alias("n_components"), F.count_if(~F.col("hit")).alias("n_unmatched"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("n"))).alias("unmatched_voxels"))


def _both_sides(vox: DataFrame, voxel_ml: float, names: dict[str, tuple[str, str, str]], within: str | None = None) -> DataFrame:
    """The counts of both masks against one another in one row per case (and `within`), 0 where a mask has none."""
    found = component_counts(vox, (("pred", "gt"), ("gt", "pred")), within=within)
    columns = []
    for mask, (n, unmatched, volume) in names.items():
        of = lambda c, mask=mask: F.coalesce(F.max(F.when(F.col("mask") == mask, F.col(c))), F.lit(0))
        columns += [of("n_components").alias(n), of("n_unmatched").alias(unmatched), (of("unmatched_voxels") * voxel_ml).alias(volume)]
    return found.groupBy("case_id", *([within] if within else [])).agg(*columns)


def case_metrics(vox: DataFrame, cases: DataFrame, voxel_ml: float, grid: int) -> DataFrame:
    """Per case: dice, false volumes in mL, missed and detected counts; cases without voxels from `cases`."""
    names = {"pred": ("pred_lesions", "false_detected", "fp_vol"), "gt": ("gt_lesions", "missed", "fn_vol")}
    found = _both_sides(vox, voxel_ml, names)
    c = confusion_counts(vox, grid).select("case_id", dice(F.col("tp"), F.col("fp"), F.col("fn"), 0.0).alias("dice"))
    out = cases.select("case_id").distinct().join(c, "case_id", "left").join(found, "case_id", "left")
    return out.na.fill(0)


#: Side of the tiles by which masks are closed.
CLOSE_TILE = 128


def _closed(c: np.ndarray, element: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Points (rows x, y, z) of the closing within the box from low to before high; outside the grid, whose part the box is, counts as filled once grown.

    low, high: two rows each, of the box and of the grid.
    """
    lo = np.maximum(low[0], c.min(axis=1) - reach)
    hi = np.minimum(high[0], c.max(axis=1) + reach + 1)
    if (lo >= hi).any():
        return np.empty((3, 0), np.int64)
    size, at = hi - lo, c - (lo - 2 * reach)[:, None]
    at = at[:, ((at >= 0) & (at < (size + 4 * reach)[:, None])).all(axis=0)]
    there = np.zeros(size + 4 * reach, bool)
    there[tuple(at)] = True
    cut = lambda a, by, n: a[tuple(slice(k, k + m) for k, m in zip(by, n, strict=True))]
    grown = np.zeros(size + 2 * reach, bool)
    for o in element:
        grown |= cut(there, reach - o, grown.shape)
    off = [np.arange(n) + k for n, k in zip(grown.shape, lo - reach, strict=True)]
    inner, filled = np.ix_(*[(i >= k) & (i < m) for i, k, m in zip(off, low[1], high[1], strict=True)]), np.ones(grown.shape, bool)
    filled[inner] = grown[inner]
    closed = cut(grown, reach, size).copy()
    for o in element:
        closed &= cut(filled, reach + o, size)
    return np.asarray(np.nonzero(closed)) + lo[:, None]


def close_mask(vox: DataFrame, mask: str, spacing: tuple[float, float, float], shape: tuple[int, int, int], shape_low: int = 1, middle_mm: float = 5.0, outer_mm: float = 0.5, tile: int = CLOSE_TILE) -> DataFrame:
    """case_id, x, y, z of the morphological closing by three slices of disks (outer, middle, outer); judged inside the grid.

    x and y count from 0, z from shape_low. A task closes a cube of `tile` voxels a
    side, with the voxels around it that reach into it, as an array of bits; one
    shuffle, in which a voxel is sent again only near borders of tiles.
    """

    def disk(mm: float, dz: int) -> list[tuple[int, int, int]]:
        r = int(mm / spacing[0])
        return [(dx, dy, dz) for dx, dy in product(range(-r, r + 1), repeat=2) if dx * dx + dy * dy <= r * r]

    element = np.asarray(disk(outer_mm, -1) + disk(middle_mm, 0) + disk(outer_mm, 1))
    reach = np.abs(element).max(axis=0)
    first = np.asarray([0, 0, shape_low])
    end = first + np.asarray(shape)
    rows = vox.where(F.col(mask) > 0).select("case_id", *XYZ)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    kinds = [pa.int64() if t == "bigint" else pa.int32() for _, t in rows.dtypes[1:]]
    for k, r, f, e in zip(XYZ, reach.tolist(), first.tolist(), end.tolist(), strict=True):
        place = lambda d, k=k, f=f, e=e: F.greatest(F.lit(f // tile), F.least(F.lit((e - 1) // tile), F.floor((F.col(k) + d) / tile).cast("int")))
        rows = rows.where((F.col(k) >= f - r) & (F.col(k) < e + r)).withColumn(f"_t{k}", F.explode(F.sequence(place(-2 * r), place(2 * r))))
    tiles = [f"_t{k}" for k in XYZ]

    def close(t: pa.Table) -> pa.Table:
        c = np.asarray([t.column(k).to_numpy() for k in XYZ], np.int64)
        low = np.asarray([t.column(k)[0].as_py() for k in tiles]) * tile
        found = _closed(c, element, reach, np.asarray([np.maximum(low, first), first]), np.asarray([np.minimum(low + tile, end), end]))
        case = t.column("case_id").combine_chunks()[:1].take(pa.array(np.zeros(found.shape[1], np.int32)))
        return pa.table([case, *[pa.array(v, kind) for v, kind in zip(found, kinds, strict=True)]], ["case_id", *XYZ])

    return dealt(rows, "case_id", *tiles).groupBy("case_id", *tiles).applyInArrow(close, schema)


def lesion_candidates(vox: DataFrame, mask: str, spacing: tuple, shape: tuple, tile: int | None = None) -> DataFrame:
    """Closed mask in 26-connected components; with `tile` found by tiles of the grid."""
    return connected_components(close_mask(vox, mask, spacing, shape).withColumn("m", F.lit(1)), "m", 26, tile=tile)


#: Maps whose means a lesion table holds: both probabilities and the three uncertainties.
MAPS = ("p0", "p1", "total", "epistemic", "aleatoric")


def lesions(vox: DataFrame, mask: str, other: str, voxel_ml: float, maps: tuple[str, ...] = MAPS, listed: str = "total", scale: int = 1) -> DataFrame:
    """One row per component of `mask`: sizes, volumes, overlap with `other`, its components hit, found or not.

    For every map its mean over the lesion, over the part that `other` meets
    (_hit) and over the rest (_false), null where a part is empty; the rest's
    values of `listed`, sorted, in `false_values`. Maps in whole numbers of
    1 / `scale` are summed as such and divided once, so the means don't depend on
    the order of rows. Both masks are labelled in one call per case.
    """
    rows = with_components(vox.select("case_id", *XYZ, mask, other, *maps), {mask: "lesion", other: "hit"}).where("lesion is not null")
    miss = F.col("hit").isNull()
    mean = lambda c: F.sum(c).cast("double") / (F.count(c) * scale).cast("double")
    means = [F.when(F.count(c) > 0, mean(c)).alias(f"{m}_{k}") for m in maps for k, c in (("mean", F.col(m)), ("hit", F.when(~miss, F.col(m))), ("false", F.when(miss, F.col(m))))]
    false_values = F.transform(F.array_sort(F.collect_list(F.when(miss, F.col(listed)))), lambda x: x / F.lit(float(scale)))
    per = rows.groupBy("case_id", "lesion").agg(F.count("*").alias("voxels"), F.count("hit").alias("tp_voxels"), F.array_sort(F.collect_set("hit")).alias("ids"), *means, false_values.alias("false_values"))
    percent = F.col("tp_voxels") * 100.0 / F.col("voxels")
    false = F.col("voxels") - F.col("tp_voxels")
    return per.withColumns({"false_voxels": false, "volume": F.col("voxels") * voxel_ml, "tp_volume": F.col("tp_voxels") * voxel_ml, "false_volume": false * voxel_ml, "overlap_percent": percent, "found": percent > OVERLAP_PERCENT, "ids": F.when(percent > OVERLAP_PERCENT, F.col("ids"))})


def image_metrics(vox: DataFrame, voxel_ml: float, grid: int) -> DataFrame:
    """Per case: confusion counts, lesions of both masks, mean uncertainty and probability (in hundredths, summed as whole numbers) in and off the ground truth, dice, sensitivity, ppv, volumes. One labelling call and one aggregate."""
    g, p, bg = F.col("gt") > 0, F.col("pred") > 0, F.col("gt") == 0
    rows = with_components(vox.select("case_id", *XYZ, "gt", "pred", "unc_pct", "p1_pct"), {"gt": "_g", "pred": "_p"})
    share = lambda s, n: s.cast("double") / (n * 100).cast("double")
    inside = lambda c: F.when(F.count_if(~bg) > 0, share(F.sum(F.when(~bg, F.col(c))), F.count_if(~bg)))
    outside = lambda c: share(F.sum(F.when(bg, F.col(c))), F.lit(grid) - F.count_if(~bg))
    means = [f(c).alias(f"{name}_{k}") for c, name in (("unc_pct", "unc"), ("p1_pct", "prob")) for k, f in (("lesion", inside), ("background", outside))]
    lesions_of = [F.coalesce(F.max(c), F.lit(0)).alias(n) for c, n in (("_g", "gt_lesions"), ("_p", "pred_lesions"))]
    out = rows.groupBy("case_id").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), *lesions_of, *means)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.withColumns({"tn": F.lit(grid) - tp - fp - fn, "dice": dice(tp, fp, fn, 0.0), "sensitivity": zero(tp, tp + fn), "ppv": zero(tp, tp + fp), "gt_volume": (tp + fn) * voxel_ml, "pred_volume": (tp + fp) * voxel_ml})


def slice_background(vox: DataFrame, slice_size: int) -> DataFrame:
    """case_id, background voxels and mean uncertainty of the background in slices that hold ground truth."""
    slices = vox.where("gt > 0").select("case_id", "z").distinct()
    rows = vox.join(slices, ["case_id", "z"], "left_semi").groupBy("case_id").agg(F.countDistinct("z").alias("k"), F.count_if(F.expr("gt > 0")).alias("fg"), F.sum(F.when(F.col("gt") == 0, F.col("unc_pct"))).alias("s"))
    n = F.col("k") * slice_size - F.col("fg")
    return rows.select("case_id", n.alias("background"), (F.coalesce("s", F.lit(0)).cast("double") / (n * 100).cast("double")).alias("unc"))


def suppress_uncertain(vox: DataFrame, cutoff: float) -> DataFrame:
    """The voxels with pred set to 0 in predicted components whose mean uncertainty exceeds the cutoff; the label travels with the voxel, so nothing is joined back."""
    rows = with_components(vox, {"pred": "_comp"})
    mean = F.avg("unc_pct").over(Window.partitionBy("case_id", "_comp")) / 100
    return rows.withColumn("pred", F.when(F.col("_comp").isNotNull() & (mean > cutoff), 0).otherwise(F.col("pred"))).drop("_comp")


def region_counts(vox: DataFrame, regions: DataFrame) -> DataFrame:
    """case_id, label, kind, name, voxels for every case and region, 0 where a region is absent."""
    n = vox.groupBy("case_id", F.col("ts").alias("label")).agg(F.count("*").alias("voxels"))
    every = vox.select("case_id").distinct().crossJoin(regions)  # the result has a row for each; Spark sends the smaller side where it is below its own limit
    kind = F.when(F.col("is_bone"), "Bone").when(F.col("description").rlike("^(liver|lung)"), "Organ").otherwise("Other")
    return every.join(n, ["case_id", "label"], "left").select("case_id", "label", kind.alias("kind"), F.col("description").alias("name"), F.coalesce("voxels", F.lit(0)).alias("voxels"))


def region_overlap(vox: DataFrame, voxel_mm3: float) -> DataFrame:
    """Per case and region: overlap of both masks with it in mm3 and percent of the region, and of one another."""
    g, p = F.col("gt") > 0, F.col("pred") > 0
    out = vox.groupBy("case_id", F.col("ts").alias("label")).agg(F.count("*").alias("n"), F.count_if(g).alias("gt_voxels"), F.count_if(p).alias("pred_voxels"), F.count_if(g & p).alias("both_voxels"))
    return out.withColumns({k + "_mm3": F.col(k + "_voxels") * voxel_mm3 for k in ("gt", "pred", "both")} | {k + "_percent": F.round(F.col(k + "_voxels") * 100.0 / F.col("n"), 2) for k in ("gt", "pred")})


def high_risk_flags(overlap: DataFrame, priority: Column) -> DataFrame:
    """Adds hr_ground and hr_pred."""
    gt = (priority & (F.col("gt_percent") > 0)) | (F.col("gt_mm3") >= HIGH_RISK_MM3)
    pred = ((priority & (F.col("pred_percent") > 0)) | (F.col("pred_mm3") >= HIGH_RISK_MM3)) & (F.col("both_mm3") >= 1)
    return overlap.withColumns({"hr_ground": gt, "hr_pred": pred})


def region_metrics(vox: DataFrame, voxel_ml: float) -> DataFrame:
    """Per case and region: dice and unmatched components, the masks cut by region before components are formed."""
    by = ("case_id", "ts")
    c = confusion_counts(vox, 0, by).select(*by, dice(F.col("tp"), F.col("fp"), F.col("fn")).alias("dice"))
    names = {"pred": ("pred_lesions", "fp_lesions", "fp_vol"), "gt": ("gt_lesions", "fn_lesions", "fn_vol")}
    found = _both_sides(vox, voxel_ml, names, within="ts")
    return c.join(found, list(by), "left").na.fill(0, [n for part in names.values() for n in part])


def merge_region_table(vox: DataFrame, regions: DataFrame, voxel_mm3: float, voxel_ml: float, priority: Column) -> DataFrame:
    """Counts, overlaps, risk flags and metrics of every case and region side by side, missing ones 0."""
    o = high_risk_flags(region_overlap(vox, voxel_mm3), priority).drop("n")
    m = region_metrics(vox, voxel_ml).withColumnRenamed("ts", "label")
    keys = ["case_id", "label"]
    return region_counts(vox, regions).join(o, keys, "left").join(m, keys, "left").na.fill(0).na.fill(False)


def high_risk_sensitivity(flags: DataFrame, by: list[str]) -> DataFrame:
    """kind (All, Organ, Bone), sensitivity: TP / (TP + FN) over the high-risk regions of a kind, 0 where there is none; flags with is_bone and description."""
    kinds = F.array_compact(F.array(F.lit("All"), F.when(F.col("is_bone"), "Bone").when(F.col("description").rlike("^(liver|lung)"), "Organ")))
    tp, fn = F.count_if(F.expr("hr_ground and hr_pred")), F.count_if(F.expr("hr_ground and not hr_pred"))
    return flags.withColumn("kind", F.explode(kinds)).groupBy(*by, "kind").agg(F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0)).alias("sensitivity"))


def mask_region_overlap(vox: DataFrame, regions: DataFrame, voxel_ml: float) -> DataFrame:
    """Volume of the prediction in bone and in the rest, and as percent of the prediction."""
    rows = vox.where("pred > 0").join(regions, vox.ts == regions.label)
    out = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.expr("is_bone")).alias("bone"))
    return out.select("case_id", (F.col("bone") * voxel_ml).alias("bone_ml"), ((F.col("n") - F.col("bone")) * voxel_ml).alias("organ_ml"), (F.col("bone") * 100.0 / F.col("n")).alias("bone_percent"))


def compare_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """case_id, same, different, shape_a, shape_b, status of two label volumes (case_id, x, y, z, v); absent voxels are 0.

    Status is missing where a case stands on one side alone. A shape is the
    extent that the occupied voxels reach, null for a missing side.
    """
    both = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["case_id", *XYZ], "full")
    shape = lambda v: F.when(F.count(v) > 0, F.concat_ws("x", *[F.max(F.when(F.col(v).isNotNull(), F.col(k) + 1)).cast("string") for k in XYZ]))
    va, vb = F.coalesce("va", F.lit(0)), F.coalesce("vb", F.lit(0))
    out = both.groupBy("case_id").agg(F.count_if(va == vb).alias("same"), F.count_if(va != vb).alias("different"), shape("va").alias("shape_a"), shape("vb").alias("shape_b"))
    missing = F.col("shape_a").isNull() | F.col("shape_b").isNull()
    return out.withColumn("status", F.when(missing, "missing").when(F.col("different") == 0, "equal").otherwise("different"))


def crop(vox: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels in each case's half-open box (x0, x1, ...), coordinates from the box's corner."""
    rows = vox.join(boxes, "case_id")
    inside = F.lit(True)
    for k in XYZ:
        inside = inside & (F.col(k) >= F.col(k + "0")) & (F.col(k) < F.col(k + "1"))
    return rows.where(inside).withColumns({k: F.col(k) - F.col(k + "0") for k in XYZ}).drop(*[k + e for k in XYZ for e in "01"])


def resample_nearest(vox: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int], first: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Order-0 zoom of a label volume: each target index takes round(i * (n - 1) / (m - 1))."""
    out = vox
    for k, n, m, f in zip(XYZ, source, target, first, strict=True):
        pairs = [(int(np.floor(i * (n - 1) / max(m - 1, 1) + 0.5)) + f, i) for i in range(m)]
        axis = out.sparkSession.createDataFrame(pairs, f"{k} int, t int")
        out = out.join(F.broadcast(axis), k).withColumn(k, F.col("t")).drop("t")  # one row per index of an axis
    return out


def _reach(k: str, order: int) -> Column:
    """Array of (_i, _w): the target indices that an axis' source index reaches and their whole weights, of a sum of max(m - 1, 1) each for order 1.

    Target i stands at i * (n - 1) / (m - 1) of the source axis, as the corners
    of both grids coincide. Everything is whole numbers, so no rounding decides.
    """
    n, m, s = (F.col(c).cast("long") for c in ("_n" + k, "_m" + k, k))
    d = F.greatest(m - 1, F.lit(1))
    step = F.greatest(n - 1, F.lit(1))
    low = F.when(n > 1, F.greatest(F.floor((s - 1) * d / step), F.lit(0))).otherwise(0)
    high = F.when(n > 1, F.least(F.ceil((s + 1) * d / step), m - 1)).otherwise(m - 1)
    near = F.when((s >= 0) & (s < n) & (low <= high), F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    if order == 0:
        weight = lambda i: F.when(F.floor((i * (n - 1) * 2 + d) / (d * 2)) == s, 1).otherwise(0)
    else:
        weight = lambda i: F.greatest(d - F.abs(i * (n - 1) - s * d), F.lit(0))
    return F.filter(F.transform(near, lambda i: F.struct(i.cast("int").alias("_i"), weight(i).cast("long").alias("_w"))), lambda t: t["_w"] > 0)


def resample(vox: DataFrame, shapes: DataFrame, values: tuple[str, ...], order: int = 1) -> DataFrame:
    """case_id, x, y, z and values on each case's own target grid: order 0 takes the nearest voxel, order 1 is linear in all three axes.

    shapes: case_id, source and target (arrays of the three lengths). Coordinates
    count from 0. A voxel that is not listed, or whose value is null, is 0; rows
    outside the source grid and cases without lengths are left out; of several
    lengths for a case the smallest hold. A row comes out for every target voxel
    that a listed voxel reaches with a weight above 0. Order 1 sums value * whole weight
    and divides once, so whole numbers give the same digits in any order of rows.

    Axis by axis: a voxel spreads to 2 m / n places of a row of the grid and is
    added up there before the next axis, not to their cube. The first two axes need
    one shuffle by slice, the third one more, before its voxels spread; no key is
    larger than a slice. A task keeps its sums in memory, so partitions are many.
    Order 0 adds nothing up and needs no shuffle beyond that of the lengths.
    """
    if order not in (0, 1):
        raise ValueError("order is 0 (nearest) or 1 (linear)")
    lengths = F.struct(*[F.col(side)[j].alias(f"_{c}{k}") for side, c in (("source", "n"), ("target", "m")) for j, k in enumerate(XYZ)])
    per = shapes.where(F.size("source") == 3).where(F.size("target") == 3).groupBy("case_id").agg(F.min(lengths).alias("_s")).select("case_id", "_s.*")
    ends = [F.col(f"_m{k}") for k in XYZ]
    rows = vox.select("case_id", *XYZ, *values).join(per, "case_id")
    names = [c for c in rows.columns if c not in XYZ and c not in values]
    for k in XYZ:
        if order == 1 and k != "y":
            rows = dealt(rows, "case_id", "z" if k == "x" else "x")
        rows = rows.select("*", F.inline(_reach(k, order)))
        if order == 0:
            rows = rows.withColumn(k, F.col("_i")).drop("_i", "_w")
            continue
        here = [F.col("_i").alias(k) if c == k else F.col(c) for c in XYZ]
        rows = rows.groupBy(*names, *here).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0)) * F.col("_w")).alias(v) for v in values])
    whole = F.lit(1)
    for m in ends:
        whole = whole * F.greatest(m.cast("long") - 1, F.lit(1))
    out = [F.coalesce(F.col(v), F.lit(0)).alias(v) if order == 0 else (F.col(v) / whole).alias(v) for v in values]
    return rows.select("case_id", *XYZ, *out)


def to_training_grid(labels: DataFrame, boxes: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """case_id, x, y, z, value: a label volume with axes reversed, cut to its case's box and taken to the shape of the case's image.

    boxes as for `crop`, in the reversed axes; target: case_id, target (array of
    three). A box as large as the target is only cut. Voxels of value 0 or null
    are left out, as the table is sparse.
    """
    cut = crop(permute_axes(labels.select("case_id", *XYZ, value).where(F.col(value) != 0), (2, 1, 0)), boxes)
    size = F.array(*[F.col(k + "1") - F.col(k + "0") for k in XYZ])
    return resample(cut, boxes.select("case_id", size.alias("source")).join(target, "case_id"), (value,), order=0)


def permute_axes(vox: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """Axis j of the result is axis order[j] of the input."""
    return vox.withColumns({XYZ[j]: F.col(XYZ[i]) for j, i in enumerate(order)})


def align_axes(vox: DataFrame, shapes: DataFrame) -> DataFrame:
    """The voxels with axes permuted by (2, 1, 0) or (2, 0, 1) where that turns a case's shape into its target; x, y, z null where neither does.

    shapes: case_id, shape, target (arrays of three); equal ones stay as they are.
    """
    turned = lambda o: F.array(*[F.col("shape")[i] for i in o])
    order = F.when(F.col("shape") == F.col("target"), F.array(*[F.lit(i) for i in (0, 1, 2)]))
    for o in ((2, 1, 0), (2, 0, 1)):
        order = order.when(turned(o) == F.col("target"), F.array(*[F.lit(i) for i in o]))
    rows = vox.join(shapes.select("case_id", order.alias("_order")), "case_id").withColumn("_at", F.array(*XYZ))
    return rows.withColumns({k: F.get("_at", F.get("_order", F.lit(j))) for j, k in enumerate(XYZ)}).drop("_order", "_at")


def uncertainty_summary(vox: DataFrame, grid: int) -> DataFrame:
    """Mean uncertainty (given in hundredths, summed as whole numbers) over the grid, above 0, in predicted and in other voxels; absent voxels are 0."""
    u, p = F.col("unc_pct"), F.col("pred") > 0
    share = lambda s, n: F.try_divide(s.cast("double"), (n * 100).cast("double"))
    mean = lambda c: share(F.sum(F.when(c, u)), F.count_if(c))
    rest = share(F.coalesce(F.sum(F.when(~p, u)), F.lit(0)), F.lit(grid) - F.count_if(p))
    return vox.groupBy("case_id").agg(share(F.sum(u), F.lit(grid)).alias("all"), mean(u > 0).alias("above_zero"), mean(p).alias("predicted"), rest.alias("non_predicted"))


def ensemble_mean(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    return samples.groupBy("case_id", *XYZ).agg(F.avg("p").alias("p")).withColumn("label", (F.col("p") > threshold).cast("int"))


def decompose_uncertainty(samples: DataFrame) -> DataFrame:
    """total = H(mean p), aleatoric = mean H(p), epistemic their difference, per voxel over samples of p; each also from 0 to 1 over the whole table (_scaled, null if constant)."""
    h = lambda p: F.when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log(1 - p))).otherwise(0.0)
    out = samples.groupBy("case_id", *XYZ).agg(F.avg("p").alias("m"), F.avg(h(F.col("p"))).alias("aleatoric"))
    out = out.withColumn("total", h(F.col("m"))).withColumn("epistemic", F.col("total") - F.col("aleatoric")).drop("m")
    names = ("aleatoric", "total", "epistemic")
    ends = out.agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("low", F.min), ("high", F.max))])
    scaled = {f"{n}_scaled": F.when(F.col(f"{n}_high") > F.col(f"{n}_low"), (F.col(n) - F.col(f"{n}_low")) / (F.col(f"{n}_high") - F.col(f"{n}_low"))) for n in names}
    return out.join(F.broadcast(ends)).withColumns(scaled).drop(*ends.columns)  # one row of extremes


def project_volume(vox: DataFrame, value: str, how: str, extent: int) -> DataFrame:
    """case_id, y, z, v: the volume over its x axis, by the mean over the grid's extent or by the maximum."""
    v = F.col(value).cast("double")
    return vox.groupBy("case_id", "y", "z").agg((F.sum(v) / extent if how == "mean" else F.max(v)).alias("v"))


def scale_uint8(images: DataFrame, mode: str = "minmax") -> DataFrame:
    """Adds v8 by mode. minmax: each case's least to greatest value as 0 to 255, truncated; cast: the value truncated; zscore: (v - mean) / population deviation. Null for a constant image but for cast."""
    if mode == "cast":
        return images.withColumn("v8", F.floor("v").cast("int"))
    if mode not in ("minmax", "zscore"):
        raise ValueError(mode)
    ends = images.groupBy("case_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    value = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 255).cast("int") if mode == "minmax" else (F.col("v") - F.col("mean")) / F.col("sd")
    return images.join(ends, "case_id").withColumn("v8", F.when(F.col("high") > F.col("low"), value)).drop(*ends.columns[1:])
