"""Balanced label propagation: documents into shards of near equal bytes, linked documents together.

Documents with equal texts are linked. Every round joins each linked document
with the votes of its group (bytes by shard, summed with partial aggregation)
and moves documents to the shard with room that most of the group is in, as far as
that shard's quota allows; groups move whole unless one is large against a shard. A
group that got no place asks again in the next round, until none moves. Where
propagation leaves documents, there they stay: only groups beyond a shard's
capacity and unlinked documents fill the shards' remaining room, along one line of
cumulative bytes, so sizes differ by less than two documents. All sums run over
buckets of keys; only tables of at most shards x buckets rows are joined by
broadcast.

Defined results: a null text has size 1 and the checksum of nothing; repeated
rows are rows of their own; ties go to the smaller shard; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import stored, table

BUCKETS = 1024
PARTS = 64


def _running(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over earlier rows of the same `by`, in order of (bucket, part, key, doc_id, nth).

    Sums per bucket first: at most shards x (BUCKETS + 128 x PARTS) rows, since
    only groups of more than a 128th of all bytes are dealt over parts.
    """
    per = df.groupBy(*by, "bucket", "part").agg(F.sum(value).alias("_sum"))
    order = Window.partitionBy(*by).orderBy("bucket", "part")
    starts = per.select(*by, "bucket", "part", (F.sum("_sum").over(order) - F.col("_sum")).alias("_from"))
    inside = Window.partitionBy(*by, "bucket", "part").orderBy("key", "doc_id", "nth")
    rows = df.withColumn("_own", value).withColumn("_in", F.sum("_own").over(inside) - F.col("_own"))
    return rows.join(F.broadcast(starts), [*by, "bucket", "part"]).withColumn(name, F.col("_from") + F.col("_in")).drop("_own", "_in", "_from")


def propagate(linked: DataFrame, groups: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """linked: key, doc_id, nth, size, large, shard; groups: key, large. The same rows with their shard after the given number of rounds."""
    for k in range(rounds):
        votes = stored(linked.groupBy("key", "shard").agg(F.sum("size").alias("w")), "counts")
        full = {r.shard: r.w for r in votes.groupBy("shard").agg(F.sum("w").alias("w")).collect()}  # one row per shard
        free = [t for t in range(shards) if full.get(t, 0) < capacity] or [0]
        # only shards with room are wished for; a group that is apart in full ones wishes for one of the others
        some = F.array(*[F.lit(t) for t in free])
        best = F.max_by(F.when(F.col("shard").isin(free), F.col("shard")), F.struct(F.col("shard").isin(free), "w", -F.col("shard")))
        want = votes.groupBy("key").agg(best.alias("want"), F.count("*").alias("n"), F.max("shard").alias("at"))
        other = F.element_at(some, (F.pmod(F.xxhash64("key", F.lit(k)), F.lit(len(free))) + 1).cast("int"))
        want = want.select("key", F.coalesce("want", F.when(F.col("n") > 1, other).otherwise(F.col("at"))).alias("want"))
        # large groups are fewer than 128, so their wishes go by broadcast and a hot group is not one task's
        big = want.join(groups.where("large").select("key"), "key", "left_semi")
        rows = linked.where("large").join(F.broadcast(big), "key").unionByName(linked.where("not large").join(want, "key"))
        rows = stored(rows, "votes")
        flow = rows.groupBy("shard", "want").agg(F.sum("size").alias("w")).collect()  # shards x shards rows
        load, inflow, out = [0.0] * shards, [0.0] * shards, [0.0] * shards
        for r in flow:
            load[r.shard] += r.w
            if r.shard != r.want:
                inflow[r.want] += r.w
                out[r.shard] += r.w
        if not any(inflow):
            return linked
        share = F.array(*[F.lit(min(1.0, max(0.0, capacity - load[t] + out[t]) / inflow[t]) if inflow[t] else 1.0) for t in range(shards)])
        drawn = F.pmod(F.when(F.col("large"), F.xxhash64("key", "doc_id", "nth", F.lit(k))).otherwise(F.xxhash64("key", F.lit(k))), F.lit(1 << 20)) / F.lit(float(1 << 20))
        linked = rows.withColumn("shard", F.when(drawn < F.element_at(share, F.col("want") + 1), F.col("want")).otherwise(F.col("shard"))).drop("want")
    return linked


def balanced_shards(documents: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law `bytes`."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("nth"))
    rows = stored(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("group_size")).where("n > 1").select("key", (F.col("group_size") > total / 128).alias("large"))
    groups = stored(groups, "groups")
    rows = rows.join(groups, "key", "left").withColumn("part", F.when(F.col("large"), F.pmod(F.xxhash64("doc_id", "nth"), F.lit(PARTS))).otherwise(F.lit(0)))
    rows = stored(rows.withColumn("bucket", F.pmod(F.col("key"), F.lit(BUCKETS))), "linked")
    start = F.pmod(F.xxhash64("doc_id", "nth"), F.lit(shards)).cast("int")
    linked = propagate(rows.where("large is not null").withColumn("shard", start), groups, shards, capacity, rounds)
    held = stored(_running(stored(linked, "rounds"), ["shard"], F.col("size"), "upto"), "held")
    end = F.col("upto") + F.col("size")
    whole = held.where("not large").withColumn("end", F.max(end).over(Window.partitionBy("shard", "key")))  # of small groups; they lose their place as wholes
    held = whole.unionByName(held.where("large").withColumn("end", end))
    keeps = F.col("end") <= F.lit(capacity)
    used = {r.shard: r.w for r in held.where(keeps).groupBy("shard").agg(F.sum("size").alias("w")).collect()}  # one row per shard
    free = rows.where("large is null").unionByName(held.where(~keeps).drop("shard", "upto", "end"))
    edges, at = [], 0.0
    for t in range(shards - 1):
        at += max(0.0, capacity - used.get(t, 0))
        edges.append(at)
    line = _running(free.withColumn("one", F.lit(0)), ["one"], F.col("size"), "upto")
    middle = F.col("upto") + F.col("size") / 2
    filled = line.withColumn("shard", sum((F.when(middle >= F.lit(x), 1).otherwise(0) for x in edges), F.lit(0)))
    placed = stored(held.where(keeps).drop("upto", "end").unionByName(filled.drop("upto", "one")), "placed")
    slots = _running(placed, ["shard"], F.lit(1).cast("long"), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
