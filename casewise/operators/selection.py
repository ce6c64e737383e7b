"""Choosing cases from embeddings: distances, extremes, top shares, diversity, kernel PCA, greedy determinantal selection.

Distances that are ordered or counted as well as returned are written once to the
shared folder, so they are computed once. No operator emits pairs of cases: distances are computed between blocks of
unit vectors inside tasks, and only each block's minima or extremes come out
(see ``cells``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.operators.cells import by_tracer, cosine_distances, extreme_pairs, nearest, vectors_of
from casewise.operators.ordering import furthest_first, numbered
from casewise.sources.files import stored

#: A side whose vectors take no more bytes than this is sent to every task; a larger one is dealt in cells.
SMALL_BYTES = 64 << 20
#: Bytes of the vectors that one scan brings a tracer's greedy selection.
POOL_BYTES = 16 << 20


def unit(embedding: Column) -> Column:
    """The vector in double precision, scaled to length one; null where its length is zero."""
    v = embedding.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unlabelled(cases: DataFrame, labelled: DataFrame) -> DataFrame:
    return cases.join(labelled.select("case_id").distinct(), "case_id", "left_anti")


def labelled(cases: DataFrame, labelled: DataFrame) -> DataFrame:
    return cases.join(labelled.select("case_id").distinct(), "case_id", "left_semi")


def _units(df: DataFrame) -> DataFrame:
    """tracer, case_id, u (the unit vector) of the vectors that have a direction."""
    return df.select("tracer", "case_id", unit(F.col("embedding")).alias("u")).where("u is not null")


def _small_side(df: DataFrame) -> dict | None:
    """Ids and unit vectors by tracer where they take at most SMALL_BYTES, else None; their size is added up before any row is fetched."""
    rows = _units(df)
    if (rows.agg(F.sum(F.size("u").cast("long") * 8)).first()[0] or 0) > SMALL_BYTES:
        return None
    out: dict = {}
    for r in rows.collect():
        out.setdefault(r.tracer, ([], []))
        out[r.tracer][0].append(r.case_id)
        out[r.tracer][1].append(r.u)
    return {k: (ids, np.asarray(v, np.float64)) for k, (ids, v) in out.items()}


def _chunks(batch: pa.RecordBatch, small: dict):
    """tracer, row numbers, vectors of a batch, in pieces that keep a distance matrix below four million numbers; rows of a tracer without a small side are left out."""
    tracers, u = np.asarray(batch.column("tracer").to_pylist(), object), batch.column("u")
    there = np.asarray(u.is_valid())
    for t, (ids, _) in small.items():
        at = np.flatnonzero((tracers == t) & there)
        step = max(1, 4_000_000 // len(ids))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield t, part, np.asarray(u.take(pa.array(part)).to_pylist(), np.float64)


def min_distance_to_labelled(pool: DataFrame, seed: DataFrame) -> DataFrame:
    """case_id, tracer, dist_to_labelled: cosine distance to the nearest labelled case of the tracer, 0 where there is none; case_id is unique, of any type.

    A labelled side of bounded size goes to every task and the pool is read
    once, without a shuffle; beyond that both sides go into cells and a pool
    vector visits only cells that may hold a nearer one. Vectors without a
    direction have 0.
    """
    small = _small_side(seed)
    if small is not None:
        shared = pool.sparkSession.sparkContext.broadcast(small)

        def scan(batches):
            for b in batches:
                d = np.zeros(b.num_rows)
                for t, at, x in _chunks(b, shared.value):
                    d[at] = cosine_distances(x, shared.value[t][1]).min(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("case_id"), b.column("tracer"), pa.array(d)], names=["case_id", "tracer", "dist_to_labelled"])

        kinds = dict(pool.dtypes)
        rows = pool.select("case_id", "tracer", unit(F.col("embedding")).alias("u"))
        return rows.mapInArrow(scan, f"case_id {kinds['case_id']}, tracer {kinds['tracer']}, dist_to_labelled double")
    best = nearest(_units(pool), _units(seed))[0].select("case_id", "ub")
    return pool.select("case_id", "tracer").join(best, "case_id", "left").select("case_id", "tracer", F.coalesce("ub", F.lit(0.0)).alias("dist_to_labelled"))


def extremes(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """tracer, kind (closest or furthest), case_a, case_b, distance, compared; over pairs of one set, or across two.

    Distances count by nine digits; ties go to the smallest ids, which may be of
    any type. `compared` says how many pairs of the tracer were compared: those
    that cells around pivots cannot rule out.
    """
    return extreme_pairs(_units(left), None if right is None else _units(right))


def distance_table(distances: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds the place of each case inside its tracer, from 0; cases are numbered on the pool, before distances are known."""
    places = numbered(pool.select("case_id", "tracer"), "case_id", [], "index", by=("tracer",))
    return distances.join(places.select("case_id", (F.col("index") - 1).cast("int").alias("index")), "case_id")


def _share(n: Column, percent: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.round(n * F.lit(percent), 9)))


def top_percent(distances: DataFrame, percent: float) -> DataFrame:
    """The furthest share of all cases: at least one, ties by id. A sort and a limit, so each task keeps only its own top."""
    distances = stored(distances, "distances")
    n = distances.count()
    most = max(1, int(np.ceil(round(n * percent, 9))))
    return distances.orderBy(F.desc("dist_to_labelled"), "case_id").limit(most)


def top_percent_by_tracer(distances: DataFrame, percent: float, totals: dict[str, int] | None = None) -> DataFrame:
    """The furthest share of each tracer, of its pool or of given totals (then possibly none)."""
    rows = stored(distances.dropDuplicates(["case_id"]) if totals else distances, "distances")
    if totals:
        size = F.coalesce(*[F.when(F.col("tracer") == k, F.lit(v)) for k, v in totals.items()], F.lit(0))
        rows = rows.withColumn("most", F.ceil(F.round(size * F.lit(percent), 9)))
    else:
        sizes = rows.groupBy("tracer").agg(_share(F.count("*"), percent).alias("most"))
        rows = rows.join(F.broadcast(sizes), "tracer")  # one row per tracer
    return furthest_first(rows, "dist_to_labelled", ["case_id"], by=("tracer",)).where("rn <= most").drop("rn", "most")


def rank_by_diversity(chosen: DataFrame) -> DataFrame:
    """Adds the mean cosine distance to the chosen cases of the tracer, itself included, and the rank by it; a single case has none and rank 1.

    The mean of distances is 1 - u . S / n with S the sum of the unit vectors,
    so no pair is formed.
    """
    rows = stored(chosen.withColumn("u", unit(F.col("embedding"))), "chosen")
    parts = rows.select("tracer", F.posexplode("u").alias("k", "v")).groupBy("tracer", "k").agg(F.sum("v").alias("s"))
    sums = parts.groupBy("tracer").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("s"))
    sizes = rows.groupBy("tracer").agg(F.count("*").alias("n"))
    out = rows.join(sums, "tracer").join(sizes, "tracer")
    mean = F.when(F.col("n") > 1, 1 - dot(F.col("u"), F.transform("s", lambda x: x["s"])) / F.col("n"))
    out = out.withColumn("avg_dist_to_top_subset", mean).withColumn("_far", F.round("avg_dist_to_top_subset", 9)).drop("u", "s", "n")
    ranked = furthest_first(stored(out, "spread"), "_far", ["case_id"], "diversity_rank", by=("tracer",))
    return ranked.withColumn("diversity_rank", F.col("diversity_rank").cast("int")).drop("_far")


def worst_covered(distances: DataFrame, k: int = 5) -> DataFrame:
    """The k furthest cases of each tracer with their place; rows are numbered by bucket, not by tracer."""
    rows = furthest_first(stored(distances, "distances"), "dist_to_labelled", ["case_id"], "place", by=("tracer",))
    return rows.withColumn("place", F.col("place").cast("int")).where(F.col("place") <= k)


def pool_tokens(tokens: DataFrame) -> DataFrame:
    """case_id, cls (token 0), patch_mean and patch_std (population, by dimension) of the other tokens; arrays, null without any.

    A token travels as one row; a case's tokens (a fixed number per image) meet
    in one array.
    """
    v = F.col("embedding").cast("array<double>")
    rows = tokens.groupBy("case_id").agg(F.first(F.when(F.col("token_idx") == 0, v), ignorenulls=True).alias("cls"), F.collect_list(F.when(F.col("token_idx") > 0, v)).alias("patch"))
    zero = F.transform(F.get("patch", F.lit(0)), lambda x: F.lit(0.0))
    n = F.size("patch").cast("double")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    rows = rows.withColumn("patch_mean", F.transform(F.aggregate("patch", zero, add), lambda x: x / n))
    apart = lambda r: F.zip_with(r, F.col("patch_mean"), lambda x, m: (x - m) * (x - m))
    rows = rows.withColumn("patch_std", F.transform(F.aggregate("patch", zero, lambda s, r: add(s, apart(r))), lambda x: F.sqrt(x / n)))
    return rows.drop("patch")


def embedding_metadata(cases: DataFrame, batch: str) -> DataFrame:
    """case_id, low and high of the image's values, mean and population deviation (std) of the embedding; batch_mean, batch_std: their means over the case's batch.

    cases: case_id, image, embedding (arrays) and the batch column. Array
    functions only; the batch means are the one shuffle.
    """
    v, x = F.col("embedding").cast("array<double>"), F.col("image").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    rows = cases.select("case_id", batch, F.array_min(x).alias("low"), F.array_max(x).alias("high"), v.alias("v")).withColumn("mean", F.try_divide(total(F.col("v")), F.size("v").cast("double")))
    std = F.sqrt(F.try_divide(F.aggregate("v", F.lit(0.0), lambda s, e: s + (e - F.col("mean")) * (e - F.col("mean"))), F.size("v").cast("double")))
    rows = rows.withColumn("std", std).drop("v")
    means = rows.groupBy(batch).agg(F.avg("mean").alias("batch_mean"), F.avg("std").alias("batch_std"))
    return rows.join(means, batch)


def distance_histogram(distances: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal-width bins from the least to the greatest distance; the last bin is closed."""
    by, distances = by or [], stored(distances, "distances")
    ends = distances.groupBy(*by).agg(F.min("dist_to_labelled").alias("low"), F.max("dist_to_labelled").alias("high"))
    rows = distances.join(F.broadcast(ends), by) if by else distances.crossJoin(F.broadcast(ends))  # one row per group
    place = F.least(F.floor((F.col("dist_to_labelled") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    return rows.withColumn("bin", F.when(F.col("high") > F.col("low"), place).otherwise(0).cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def kmeans_clusters(cases: DataFrame, k: int, starts: int = 10) -> DataFrame:
    """case_id, cluster by the best of several seeded starts on the raw embeddings."""
    rows = cases.select("case_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows = stored(rows, "features")
    models = [KMeans(k=k, seed=s).fit(rows) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("case_id", F.col("prediction").alias("cluster"))


def _moments(units: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sum and the second moments of unit vectors, added up inside tasks: d x d numbers each."""

    def add(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([x.sum(axis=0).tolist()]), pa.array([(x.T @ x).ravel().tolist()])], names=["n", "s", "m"])

    parts = units.select("u").mapInArrow(add, "n long, s array<double>, m array<double>")
    n = parts.agg(F.sum("n")).first()[0] or 0
    fold = lambda c: [r.v for r in parts.select(F.posexplode(c).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()]  # noqa: E731  d or d*d numbers
    s = np.asarray(fold("s"))
    return n, s, np.asarray(fold("m")).reshape(len(s), len(s))


def cosine_kernel_pca(fit_on: DataFrame, apply_to: DataFrame, components: int = 2) -> DataFrame:
    """case_id, pc: projections of kernel PCA with the cosine kernel, which is PCA of unit vectors centred by the fitted mean.

    Each component's sign is that which makes its largest loading positive.
    """
    n, s, m = _moments(fit_on.select(unit(F.col("embedding")).alias("u")).where("u is not null"))
    mean = s / n
    _, vectors = np.linalg.eigh(m / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    u = unit(F.col("embedding"))
    pcs = [dot(u, F.array(*[F.lit(float(x)) for x in axes[:, k]])) - float(mean @ axes[:, k]) for k in range(axes.shape[1])]
    return apply_to.select("case_id", F.array(*pcs).alias("pc"))


def _best_gains(batches: Iterator[pa.RecordBatch], inverse: dict, chosen: set, most: int, epsilon: float) -> Iterator[pa.RecordBatch]:
    """tracer, case_id, gain of a task's `most` + 1 best rows of each tracer in `inverse`, the greatest gains (by twelve digits) first, then the least ids."""
    best: dict = {t: [] for t in inverse}
    kind, tracer_kind = None, None
    for b in batches:
        kind, tracer_kind = b.schema.field("case_id").type, b.schema.field("tracer").type
        for t, at in by_tracer(b):
            if t in inverse:
                x, ids = vectors_of(b.column("u"), at), b.column("case_id").take(pa.array(at)).to_pylist()
                g = np.einsum("ij,ij->i", x, x) if inverse[t] is None else epsilon * np.einsum("ij,ij->i", x @ inverse[t], x)
                rows = [(-v, i) for v, i in zip(np.round(g, 12).tolist(), ids, strict=True) if (t, i) not in chosen]
                best[t] = sorted(best[t] + rows)[: most + 1]
    rows = [(t, i, -v) for t, part in best.items() for v, i in part]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (tracer_kind, kind, pa.float64()), strict=True)], names=["tracer", "case_id", "gain"])


def dpp_greedy(cases: DataFrame, k: int, quality: str | None = None, epsilon: float = 1e-6) -> DataFrame:
    """tracer, pick (from 1), case_id, gain: greedy determinantal selection with the cosine kernel.

    The gain of x given the chosen rows X is e * x'(X'X + eI)^-1 x, so the driver
    keeps one d x d matrix per tracer. Gains only fall as rows are chosen, so one
    scan serves many picks: it brings each tracer's best POOL_BYTES of vectors and
    the gain of the best row left out. Rows of the pool are refreshed from a heap,
    and a pick stands while its gain is above that of all rows outside; else the
    next scan brings a new pool. Ties, by twelve digits, go to the smallest
    case_id.
    """
    u = unit(F.col("embedding"))
    rows = cases.withColumn("u", u).where("u is not null")
    if quality:
        top = rows.agg(F.max(quality)).first()[0]
        rows = rows.withColumn("u", F.transform("u", lambda x: x * F.col(quality) / F.lit(float(top if top is not None else 1))))
    rows = stored(rows.select("tracer", "case_id", "u"), "units")
    spark, kinds = cases.sparkSession, dict(cases.dtypes)
    tracers = {r.tracer: r.d for r in rows.groupBy("tracer").agg(F.max(F.size("u")).alias("d")).collect()}
    inverse: dict = dict.fromkeys(tracers)
    picks: dict = {t: [] for t in tracers}
    chosen: set = set()
    most = max(2, POOL_BYTES // (8 * max(tracers.values(), default=1)))
    while active := [t for t in tracers if len(picks[t]) < k]:
        state = spark.sparkContext.broadcast(({t: inverse[t] for t in active}, set(chosen)))
        scanned = rows.mapInArrow(lambda batches, state=state: _best_gains(batches, *state.value, most, epsilon), f"tracer {kinds['tracer']}, case_id {kinds['case_id']}, gain double")
        order = Window.partitionBy("tracer").orderBy(F.desc("gain"), "case_id")
        pool = scanned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
        found = pool.join(rows, ["tracer", "case_id"]).select("tracer", "case_id", "gain", "place", "u").collect()  # a pool is bounded by POOL_BYTES
        for t in active:
            mine = [r for r in found if r.tracer == t]
            outside = max((r.gain for r in mine if r.place > most), default=-np.inf)
            vectors = {r.case_id: np.asarray(r.u) for r in mine if r.place <= most}
            heap = [(-r.gain, r.case_id, len(picks[t])) for r in mine if r.place <= most]
            heapq.heapify(heap)
            first = True
            while heap and len(picks[t]) < k:
                gain, i, age = heap[0]
                x = vectors[i]
                if age < len(picks[t]):
                    heapq.heapreplace(heap, (-round(float(epsilon * (x @ inverse[t] @ x)), 12), i, len(picks[t])))
                    continue
                if not first and -gain <= outside:
                    break
                heapq.heappop(heap)
                first = False
                m = np.eye(len(x)) / epsilon if inverse[t] is None else inverse[t]
                y = m @ x
                inverse[t] = m - np.outer(y, y) / (1 + x @ y)
                chosen.add((t, i))
                picks[t].append((t, len(picks[t]) + 1, i, -gain))
            if not heap and outside == -np.inf:
                tracers.pop(t)  # all its rows are chosen
    return spark.createDataFrame([p for part in picks.values() for p in part], f"tracer {kinds['tracer']}, pick int, case_id {kinds['case_id']}, gain double")
