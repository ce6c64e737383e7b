"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. After a
fixed rotation the coordinates are split into blocks; each block gets a share
of that budget in proportion to its dimensions, and a pair within the whole
budget is within the share of at least one block. So every block is
range-joined on its own: vectors go to the grid cell of the block's first
coordinates and, as guests, to every cell within the block's radius; inside a
cell the whole block's distance is compared, and the union of the candidates
is verified exactly: copies carry the turned vector in 16 bits a coordinate,
whose rounding moves a distance by at most a known amount. Pairs further than
that from the threshold are decided by it; the vectors of the others' members
are fetched, and those pairs are decided in double precision on the vectors as
given. A vector has ``most_blocks`` blocks at most, wider ones where it is long, so
its copies do not grow with its length.

Pairs never become rows: a pair is decided where the vector with the smaller
number is at home, in the first block whose share it keeps, and a cell
returns, per vector, how many vectors it links to and the least one it is
connected with. Inside a cell the home vectors are halved along their widest
coordinate again and again, and vectors outside a half's reach drop out, so far
fewer pairs are compared than the cell has. A cell with more than ``chunk``
vectors is dealt in parts, each with itself and every other, so a task holds
two parts at most; the grid takes a further coordinate where that makes fewer
rows. Links become counts and roots step by step.

Equal vectors are one class and are compared once.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; a row
whose vec_id is null is a member of its vector's class, and a class without any
vec_id is compared like the others (its ids are null); ties and repeated rows
are one class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import connected, stored, table
from casewise.llm.shingles import mixed

#: Rotated coordinates travel as 16-bit integers of this scale; SLACK, added to every share, is above their rounding.
SCALE = 32767
SLACK = 1e-4
#: So many home vectors are compared at once.
LEAF = 32


@functools.cache
def rotation(dims: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _cells(x: np.ndarray, radius: float, side: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cell coordinates, whether it is their home) for every cell of the grid that each point's ball may reach."""
    n, dims = x.shape
    low, high, home = (np.floor((x + d) / side).astype(np.int64) for d in (-radius, radius, 0))
    for step in np.ndindex(*([3] * dims)):
        shift = np.asarray(step) - 1
        cell = home + shift
        gap = np.where(shift < 0, x - home * side, np.where(shift > 0, (home + 1) * side - x, 0.0))
        near = ((cell >= low) & (cell <= high)).all(axis=1) & ((gap**2).sum(axis=1) <= radius**2)
        yield np.flatnonzero(near), cell[near], not shift.any()


def _cell_names(cells: np.ndarray, dims: int, b: int) -> np.ndarray:
    """One 64-bit name per cell of block b of vectors of `dims` components."""
    name = np.full(len(cells), dims * 4096 + b, np.uint64)
    for c in cells.T:
        name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return name.view(np.int64)


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merges the trees of linked members; every root is its tree's least member."""
    while True:
        a, b = parent[left], parent[right]
        new = a != b
        if not new.any():
            return
        left, right, a, b = left[new], right[new], a[new], b[new]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _close(block: np.ndarray, homes: np.ndarray, others: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (home, other) within the squared distance `reach` in a block, a few homes at a time.

    Homes are halved along their widest coordinate; others too far from the box
    of a half are left out before it is halved again.
    """
    part = block[homes]
    low, high = part.min(axis=0), part.max(axis=0)
    others = others[(np.maximum(0, np.maximum(low - block[others], block[others] - high)) ** 2).sum(axis=1) <= reach]
    if not len(others):
        return
    if len(homes) > LEAF:
        order = np.argsort(part[:, np.argmax(high - low)], kind="stable")
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            yield from _close(block, homes[half], others, reach)
        return
    other = block[others]
    near = (part**2).sum(axis=1)[:, None] + (other**2).sum(axis=1)[None, :] - 2 * (part @ other.T) <= reach
    i, j = np.nonzero(near)
    yield homes[i], others[j]


def _bytes_of(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows_of(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The reverse of _bytes_of."""
    return np.concatenate([np.frombuffer(c.buffers()[2], dtype)[c.offset * (w := len(c[0].as_py()) // np.dtype(dtype).itemsize) :][: len(c) * w].reshape(len(c), w) for c in column.chunks if len(c)])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of vectors as given, in double precision."""
    a, b = (x.astype(np.float64) / np.abs(x).max(axis=1, keepdims=True).astype(np.float64) for x in (a, b))
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


class Layout:
    """How vectors of any length are turned, cut into blocks and put into cells; travels to the tasks."""

    def __init__(self, budget: float, block_dims: int, grid_dims: int, most_blocks: int = 8) -> None:
        self.budget, self.block_dims, self.grid_dims, self.most_blocks = budget, block_dims, grid_dims, most_blocks

    def bounds(self, dims: int) -> list[tuple[int, int]]:
        width = max(self.block_dims, -(-dims // self.most_blocks))
        return [(s, min(dims, s + width)) for s in range(0, dims, width)]

    def shares(self, dims: int) -> list[float]:
        return [self.budget * (e - s) / dims + SLACK for s, e in self.bounds(dims)]

    def certain(self, dims: int) -> tuple[float, float]:
        """Squared distances of turned vectors in 16 bits up to which a pair is within the budget, and above which it is not."""
        most = sqrt(dims) / SCALE + 1e-9  # each vector is within half a step of its own in every coordinate
        return max(0.0, sqrt(self.budget) - most) ** 2, (sqrt(self.budget) + most) ** 2

    def placed(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, bool]]:
        """(their places in the batch, turned vectors of one length, block, of these the rows that reach some cells, those cells, whether they are home)."""
        lens = np.asarray([len(v) for v in vectors])
        for dims in np.unique(lens).tolist():
            at = np.flatnonzero(lens == dims)
            raw = np.asarray([vectors[k].as_py() for k in at.tolist()], np.float64)
            scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            turned = np.rint(unit @ rotation(dims) * SCALE).astype("<i2")
            for b, ((s, e), share) in enumerate(zip(self.bounds(dims), self.shares(dims), strict=True)):
                for rows, cell, home in _cells(turned[:, s:e][:, : self.grid_dims] / SCALE, sqrt(share), 2 * sqrt(share)):
                    if len(rows):
                        yield at, turned, b, rows, _cell_names(cell, dims, b), home


def _cell_sizes(found: DataFrame, layout: Layout) -> DataFrame:
    """cell, n: how many vectors reach each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, names, _ in layout.placed(batch.column(0)):
                cell, n = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return found.select("embedding").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _laid_out(found: DataFrame, budget: float, block_dims: int, most_grid_dims: int, chunk: int, most_blocks: int) -> tuple[Layout, dict[int, int]]:
    """The layout that makes fewest rows, and the parts of cells that hold more than a chunk.

    Cells are few by geometry: at most (1 / radius + 1) ** grid_dims a block.
    """
    best = None
    for grid_dims in range(2, most_grid_dims + 1):
        layout = Layout(budget, block_dims, grid_dims, most_blocks)
        sizes = stored(_cell_sizes(found, layout), "cells")
        made = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / chunk))).first()[0] or 0
        if best and made >= best[0]:
            break
        best = made, layout, sizes
        if sizes.where(F.col("n") > chunk).isEmpty():
            break
    parts = best[2].where(F.col("n") > chunk).select("cell", F.ceil(F.col("n") / chunk).alias("parts"))
    return best[1], {r.cell: r.parts for r in parts.collect()}


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, block_dims: int = 16, most_grid_dims: int = 3, chunk: int = 32_768, most_blocks: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_id: one row per vector; links join vectors whose cosine is at least `cosine`."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    rows = embeddings.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), F.col("embedding")).alias("embedding"))
    name = F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding", F.size("embedding")))
    rows = stored(rows.select("vec_id", "embedding", F.coalesce(name, F.xxhash64(F.lit("none"), "vec_id")).alias("c")), "vectors")
    classes = rows.groupBy("c").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding"))
    classes = stored(classes, "classes")
    found = classes.where("embedding is not null")
    layout, parts = _laid_out(found, 2 - 2 * cosine, block_dims, most_grid_dims, chunk, most_blocks)
    parts = embeddings.sparkSession.sparkContext.broadcast(parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = (batch.column(k).to_numpy() for k in (0, 1))
            for at, turned, b, rows_, names, home in layout.placed(batch.column(2)):
                many = np.asarray([parts.value.get(k, 1) for k in names.tolist()])
                own = ids[at[rows_]] % many
                for other in range(int(many.max())):  # a part of a large cell meets itself and every other
                    k = np.flatnonzero(other < many)
                    columns = {"cell": names[k], "i": np.minimum(own[k], other), "j": np.maximum(own[k], other), "own": own[k], "b": np.full(len(k), b), "home": np.full(len(k), home)}
                    columns |= {"c": ids[at[rows_[k]]], "size": size[at[rows_[k]]], "turned": _bytes_of(turned[rows_[k]])}
                    yield pa.RecordBatch.from_pydict(columns)

    member = "cell long, i long, j long, own long, b long, home boolean, c long, size long, turned binary"
    names = ["links", "root", *(f.split()[0] for f in member.split(", "))]
    placed = found.select("c", "size", "embedding").mapInArrow(place, member)

    def join(t: pa.Table) -> pa.Table:
        """Links of a cell. Where members come without their vectors: those that 16 bits decide, and (links is null) the members of the pairs left open."""
        t = t.sort_by("c")
        home, ids, size, own = (t.column(k).to_numpy() for k in ("home", "c", "size", "own"))
        b, i, j = (t.column(k)[0].as_py() for k in ("b", "i", "j"))
        turned, whole = _rows_of(t.column("turned"), "<i2"), "embedding" in t.column_names
        raw = np.asarray(t.column("embedding").to_pylist(), np.float64) if whole else None
        dims = turned.shape[1]
        bounds, share, (sure, most) = layout.bounds(dims), layout.shares(dims), layout.certain(dims)
        block = (turned[:, slice(*bounds[b])] / SCALE).astype(np.float32)
        links, parent, unsure = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
        sides = [(home, np.ones(len(ids), bool))] if i == j else [(home & (own == x), own == y) for x, y in ((i, j), (j, i))]
        for homes, others in (map(np.flatnonzero, x) for x in sides):
            for left, right in _close(block, homes, others, share[b] + SLACK) if len(homes) else ():
                left, right = left[ids[left] < ids[right]], right[ids[left] < ids[right]]
                for k in range(b + 1):  # decided in the first block whose share the pair keeps
                    s, e = bounds[k]
                    d = ((turned[left, s:e].astype(np.int64) - turned[right, s:e]) ** 2).sum(axis=1) / SCALE**2
                    keep = d <= share[k] if k == b else d > share[k]
                    left, right = left[keep], right[keep]
                if not len(left):
                    continue
                d = ((turned[left].astype(np.int64) - turned[right]) ** 2).sum(axis=1) / SCALE**2
                between = (d > sure) & (d <= most)
                if whole:
                    left, right = left[between], right[between]
                    linked = _cosines(raw[left], raw[right]) >= cosine
                else:
                    unsure[left[between]] = unsure[right[between]] = True
                    linked = d <= sure
                left, right = left[linked], right[linked]
                links += (np.bincount(left, size[right], len(ids)) + np.bincount(right, size[left], len(ids))).astype(np.int64)
                _union(parent, left, right)
        hit = np.flatnonzero(links)
        out = pa.table({"c": ids[hit], "links": links[hit], "root": ids[parent[hit]]})
        waiting = t.take(pa.array(np.flatnonzero(unsure)))
        return pa.concat_tables([out, waiting], promote_options="default").select(names)

    result = f"links long, root long, {member}"
    links = stored(placed.groupBy("cell", "i", "j").applyInArrow(join, result), "links")
    waiting = links.where("links is null").drop("links", "root").join(found.select("c", "embedding"), "c")
    more = stored(waiting.groupBy("cell", "i", "j").applyInArrow(join, result), "links")
    links = links.unionByName(more).where("links is not null").select("c", "links", "root")
    counts = links.groupBy("c").agg(F.sum("links").alias("links"))
    groups = stored(connected(links, "c", "root").select(F.col("id").alias("c"), F.col("component_id").alias("component")), "groups")
    low = groups.join(classes.select("c", "class_id"), "c").groupBy("component").agg(F.min("class_id").alias("component_id"))
    per_class = classes.select("c", "class_id", "size", F.col("embedding").isNotNull().alias("sound"))
    per_class = per_class.join(counts, "c", "left").join(groups, "c", "left").join(low, "component", "left")
    out = rows.select("vec_id", "c").join(per_class, "c")
    alike = F.when(F.col("sound"), F.col("size") - 1).otherwise(F.lit(0)) + F.coalesce("links", F.lit(0))
    least = F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id"))
    own_id = F.when(F.col("sound"), least).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        alike.cast("long").alias("n_links"),
        own_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == own_id, own_id.isNull()).alias("kept"),
        F.when(F.col("sound"), F.col("class_id")).otherwise(F.col("vec_id")).alias("class_id"),
    )


def op2_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
