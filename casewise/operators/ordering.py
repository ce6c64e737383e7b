"""Global row numbers without sending all rows to one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.sources.files import stored

#: Partitions that `dealt` makes at least.
PARTS = 192


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys in at least PARTS partitions that Spark does not put together by their bytes.

    For steps whose time or memory goes by rows: voxels take few bytes, and of the
    partitions that adaptive execution would make of them one holds millions.
    """
    return df.repartition(max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Cut points for values that are cosine distances.
DISTANCE_EDGES = [k / 2048 for k in range(1, 4096)]


def numbered(df: DataFrame, number: str, then: list[str], name: str = "rn", buckets: int = 64, by: tuple[str, ...] = (), edges: list[float] | None = None) -> DataFrame:
    """Adds 1, 2, ... in order of a numeric column (nulls last) and tie-breaking columns, on its own for every value of `by`.

    Rows are bucketed by approximate quantiles of the column, or by given cut
    points, which saves the pass that finds them; each bucket is numbered on its
    own and shifted by the sizes of those before it (a table of at most one row
    per bucket and value of `by`).
    """
    rows = bucketed(df, number, buckets, edges)
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(F.asc_nulls_last("_v"), *then))
    return rows.withColumn("_r", inside).join(F.broadcast(_starts(sizes, by)), [*by, "_b"]).withColumn(name, F.col("_r") + F.col("_s")).drop("_v", "_b", "_r", "_s")


def bucketed(df: DataFrame, number: str, buckets: int, edges: list[float] | None) -> DataFrame:
    """Adds _v, the column as a double, and _b, its bucket, in the same order; nulls are the last."""
    value = F.col(number).cast("double")
    if edges is None:
        edges = df.select(value.alias("v")).approxQuantile("v", [k / buckets for k in range(1, buckets)], 0.002)
    cuts = sorted(set(edges))
    rows = df.withColumn("_v", value)
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("_b", F.lit(0.0))
    return rows.withColumn("_b", F.coalesce("_b", F.lit(float(len(cuts) + 2))))


def _starts(sizes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sum _s of _n of the buckets before each; one row per bucket and value of `by`."""
    before = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    return sizes.select(*by, "_b", (F.sum("_n").over(before) - F.col("_n")).alias("_s"))


def mean_ranks(df: DataFrame, number: str, by: tuple[str, ...], kept: dict[str, Column] | None = None, buckets: int = 64) -> DataFrame:
    """`by`, the number, ties, rank and `kept` (aggregates of the rows of a value): one row per distinct value, its rank the average place of its rows, from 1.

    Rows of one value become one row before anything is ordered, so a value that
    any number of rows share costs one task nothing; distinct values are ordered
    bucket by bucket, and the rows before a bucket are a prefix sum.
    """
    kept = kept or {}
    values = stored(df.groupBy(*by, number).agg(F.count("*").alias("ties"), *[c.alias(n) for n, c in kept.items()]), "values")
    rows = bucketed(values, number, buckets, None)
    sizes = rows.groupBy(*by, "_b").agg(F.sum("ties").alias("_n"))
    inside = F.sum("ties").over(Window.partitionBy(*by, "_b").orderBy(F.asc_nulls_last("_v")))
    place = F.col("_s") + F.col("_r") - F.col("ties") + (F.col("ties") + 1) / 2
    return rows.withColumn("_r", inside).join(F.broadcast(_starts(sizes, by)), [*by, "_b"]).select(*by, number, "ties", place.alias("rank"), *kept)


def furthest_first(df: DataFrame, distance: str, then: list[str], name: str = "rn", by: tuple[str, ...] = ()) -> DataFrame:
    """numbered() by a cosine distance, the greatest first."""
    rows = numbered(df.withColumn("_far", -F.col(distance)), "_far", then, name, by=by, edges=[-e for e in DISTANCE_EDGES])
    return rows.drop("_far")


def quantile_group(df: DataFrame, number: str, then: list[str], groups: int, name: str) -> DataFrame:
    """Adds 1..groups as ntile does: sizes differ by at most one, the first ones larger."""
    n = df.count()
    small, more = divmod(n, groups)
    rows = numbered(df, number, then, "_rn")
    big = more * (small + 1)
    place = F.when(F.col("_rn") <= big, F.ceil(F.col("_rn") / (small + 1))).otherwise(more + F.ceil((F.col("_rn") - big) / max(small, 1)))
    return rows.withColumn(name, place.cast("int")).drop("_rn")
