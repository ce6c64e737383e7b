"""Set algebra over training splits: long rows (split_id, role, case_id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.ordering import furthest_first, numbered, quantile_group
from casewise.sources.files import stored


def _with_sizes(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.groupBy("tracer").agg(F.count("*").alias("n"))), "tracer")  # one row per tracer


def prefix_splits(cases: DataFrame, percents: list[int]) -> DataFrame:
    """percent, tracer, case_id: per tracer the first floor(n * p / 100) cases in order of id; nested."""
    rows = numbered(_with_sizes(cases.select("case_id", "tracer")), "case_id", [], by=("tracer",))
    rows = rows.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    return rows.where(F.col("rn") * 100 <= F.col("n") * F.col("percent")).select("percent", "tracer", "case_id")


def selection_splits(base: DataFrame, ranked: DataFrame, percents: list[int]) -> DataFrame:
    """percent, case_id: the base cases and, per tracer, the furthest share of the ranked pool (at least one case)."""
    rows = furthest_first(_with_sizes(stored(ranked, "distances")), "dist_to_labelled", ["case_id"], by=("tracer",))
    every = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    most = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("percent") / 100))
    chosen = rows.select("*", every).where(F.col("rn") <= most).select("percent", "case_id")
    return chosen.union(base.select(every, "case_id")).distinct()


def dpp_splits(picks: DataFrame, base: DataFrame, counts: list[int]) -> DataFrame:
    """budget, case_id: greedy picks are nested, so one run to the largest budget gives all of them."""
    rows = picks.withColumn("budget", F.explode(F.array(*[F.lit(c) for c in counts]))).where(F.col("pick") <= F.col("budget")).select("budget", "case_id")
    return rows.union(base.select(F.explode(F.array(*[F.lit(c) for c in counts])), "case_id")).distinct()


def random_splits(pool: DataFrame, sizes: DataFrame, seeds: list[int], base: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """seed, tracer, case_id: the base cases and, per tracer, as many of the pool as `sizes` says, in order of a seeded hash.

    `existing` (tracer, case_id) is taken over as seed 0.
    """
    every = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    rows = pool.select("case_id", "tracer", every).withColumn("h", F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("case_id").cast("string"))))
    rows = rows.withColumn("start", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))  # hashes are even, so are buckets of their start
    picks = numbered(rows, "start", ["h", "case_id"], by=("seed", "tracer"), edges=list(range(64, 65536, 64))).join(sizes, "tracer").where("rn <= n").select("seed", "tracer", "case_id")
    out = picks.unionByName(base.select("tracer", "case_id", every))
    if existing is not None:
        out = out.unionByName(existing.select("tracer", "case_id", F.lit(0).alias("seed")))
    return out.distinct()


def quartile_splits(base: DataFrame, scored: DataFrame) -> DataFrame:
    """step (0-4), case_id: the base and the cases of the first quartiles of the score."""
    q = quantile_group(scored, "score", ["case_id"], 4, "q").select("case_id", "q")
    steps = F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("step")
    return q.select("case_id", "q", steps).where("q <= step").select("step", "case_id").union(base.select(steps, "case_id")).distinct()


def overlap_matrix(splits: DataFrame) -> DataFrame:
    """i, j, n: training cases that splits i and j share, zeros included.

    Cases get whole numbers, and a split is a bitmap per 32,768 of them. A task
    counts the common bits of all splits in one such range with one product of
    matrices, so a range gives splits x splits numbers, however many cases it has.
    """
    t = splits.where("role = 'train'").select("split_id", "case_id").distinct()
    cases = numbered(t.select("case_id").distinct().withColumn("_h", F.xxhash64("case_id")), "_h", ["case_id"], "_no").select("case_id", "_no")
    maps = t.join(cases, "case_id").groupBy("split_id", F.bitmap_bucket_number("_no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_no")).alias("bits"))
    kind = dict(splits.dtypes)["split_id"]

    def count(t: pa.Table) -> pa.Table:
        ids, n = t.column("split_id").combine_chunks(), t.num_rows
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(n, -1)
        shared = np.zeros((n, n), np.int64)
        for k in range(0, bits.shape[1], 256):
            part = np.unpackbits(bits[:, k : k + 256], axis=1).astype(np.float32)
            shared += (part @ part.T).astype(np.int64)
        i, j = np.nonzero(shared)
        return pa.table({"i": ids.take(pa.array(i)), "j": ids.take(pa.array(j)), "n": shared[i, j]})

    pairs = maps.groupBy("bucket").applyInArrow(count, f"i {kind}, j {kind}, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    ids = t.select("split_id").distinct()
    every = ids.select(F.col("split_id").alias("i")).crossJoin(ids.select(F.col("split_id").alias("j")))  # the result has a row for each
    return every.join(pairs, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))


def common_to_all(splits: DataFrame) -> DataFrame:
    t = splits.where("role = 'train'")
    n = t.select("split_id").distinct().count()
    return t.groupBy("case_id").agg(F.countDistinct("split_id").alias("k")).where(F.col("k") == n).select("case_id")


def intersection_sizes(splits: DataFrame, chosen: DataFrame) -> DataFrame:
    """split_id, n: training cases of each split that `chosen` (case_id) holds, 0 included; split_id null counts those common to all splits."""
    t = splits.where("role = 'train'").select("split_id", "case_id").distinct()
    mark = chosen.select("case_id").distinct().withColumn("hit", F.lit(1))
    each = t.join(mark, "case_id", "left").groupBy("split_id").agg(F.count("hit").alias("n"))
    return each.unionByName(common_to_all(splits).agg(F.count("*").alias("n")).select(F.lit(None).cast("int").alias("split_id"), "n"))


def check_leakage(splits: DataFrame, patients: DataFrame) -> DataFrame:
    """split_id, patient_id, n_cases of patients whose scans stand in more than one role."""
    rows = splits.select("split_id", "role", "case_id").join(patients.select("case_id", "patient_id"), "case_id")
    return rows.groupBy("split_id", "patient_id").agg(F.countDistinct("role").alias("roles"), F.countDistinct("case_id").alias("n_cases")).where("roles > 1").drop("roles")


def label_manifest(train: DataFrame, validation: DataFrame, everything: DataFrame, listing: DataFrame, done: DataFrame) -> DataFrame:
    """case_id, source (hard, pseudo, validation), status of every case: MISSING without a label in the listing, EXISTS where it is linked already, else OK."""
    hard = train.select("case_id", F.lit("hard").alias("source"))
    val = validation.select("case_id", F.lit("validation").alias("source"))
    rest = everything.select("case_id").join(hard.union(val).select("case_id"), "case_id", "left_anti").select("case_id", F.lit("pseudo").alias("source"))
    rows = hard.union(val).union(rest).distinct()
    mark = lambda df, name: df.select("case_id").distinct().withColumn(name, F.lit(True))
    out = rows.join(mark(listing, "there"), "case_id", "left").join(mark(done, "linked"), "case_id", "left")
    return out.select("case_id", "source", F.when(F.col("there").isNull(), "MISSING").when(F.col("linked"), "EXISTS").otherwise("OK").alias("status"))


def compare_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    """split_id, n_same, n_different over positions (split_id, pos, case_id) of two ordered splits."""
    both = a.select("split_id", "pos", F.col("case_id").alias("ca")).join(b.select("split_id", "pos", F.col("case_id").alias("cb")), ["split_id", "pos"], "full")
    return both.groupBy("split_id").agg(F.count_if(F.col("ca").eqNullSafe(F.col("cb"))).alias("n_same"), F.count_if(~F.col("ca").eqNullSafe(F.col("cb"))).alias("n_different"))


def tracer_counts(splits: DataFrame) -> DataFrame:
    """split_id, role, FDG, PSMA."""
    return splits.groupBy("split_id", "role").pivot("tracer", ["FDG", "PSMA"]).count().na.fill(0)
