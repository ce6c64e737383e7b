"""Merging labels of many groups at once: connected components of an edge list, without one group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.sources.files import stored


def merged(edges: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, label, root: the least label that each label is joined with through edges of its own group; labels without an edge have no row.

    Rounds of joining every neighbour to the least one, first of greater and then
    of smaller labels, so distances halve; a round is two aggregates and two
    equi-joins and goes through the shared folder. Self loops and nulls count for
    nothing.
    """
    keys = list(by)
    name = lambda df, x, y: df.select(*keys, F.col(x).alias("hi"), F.col(y).alias("lo"))
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(*keys, F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e, before = stored(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "hi", "lo").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            roots = e.select(*keys, F.col("lo").alias("label")).distinct()
            return e.select(*keys, F.col("hi").alias("label"), F.col("lo").alias("root")).unionByName(roots.withColumn("root", F.col("label")))
        before = now
        both = name(e, "hi", "lo").unionByName(name(e, "lo", "hi"))
        least = both.groupBy(*keys, "hi").agg(F.min(F.least("hi", "lo")).alias("m"))
        large = both.join(least, [*keys, "hi"]).where("lo > hi and lo > m")
        large = name(large, "lo", "m").distinct()
        least = large.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
        small = name(large.join(least, [*keys, "hi"]).where("lo > m"), "lo", "m")
        e = stored(small.unionByName(name(least, "hi", "m")).distinct(), "edges")
