"""The prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns' digests; prefixes of paths are nodes.
Paths, with their conversation's id to break ties, are dealt by range: splitters
are chosen from a sample, and every shard holds what lies between two of them,
sorted. All members of a node lie side by side in that order, so a node with
members in two shards is a prefix of a splitter between them. The trie of the
splitters, the skeleton, goes to every task: a shard walks its sorted paths once
with a stack of open nodes and finishes every node off the skeleton by itself;
for nodes of the skeleton it gives partial aggregates, which are added up over
the shards, folded along the skeleton and written out. Equal conversations differ
in their ids, so a group of copies of any size spreads over shards.

Only digests, word counts and ids travel; texts stay where they are read. The
hash over a node's ids is sequential by definition: shards give their ids as text
in order, and one task hashes a skeleton node's blocks as they stream by.

Defined results: null roles and texts are empty; a null turn comes first; turns
of one number (ties) go by the digest of role and text; repeated rows are turns
like others; rows without conv_id belong to no conversation and are left out;
``%`` keeps the dividend's sign; texts of any length are hashed and counted
whole, while a conversation's digests (24 bytes a turn) must fit in a task;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import stored, table

#: Bytes of a turn's digest, which is a step of a path; bytes of paths that one shard is to hold; sampled paths a shard; bytes of all splitters.
STEP = 16
SHARD_BYTES = 64 << 20
SAMPLED = 20
SKELETON_BYTES = 8 << 20
#: Bytes of one block of ids; rows of one batch.
BLOCK = 1 << 20
ROWS = 20_000
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
OUT = pa.schema([(n, pa.int64()) for n in NODE] + [("ends_sha256", pa.string()), ("skeleton", pa.int64()), ("shard", pa.int64()), ("words", pa.int64()), ("block", pa.int64()), ("ids", pa.binary())])


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns: (digest, words) of each turn in order; digests are hexadecimal."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)
    one = F.struct(F.col("turn").isNotNull().alias("later"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    rows = turns.where("conv_id is not null").select("conv_id", one.alias("t"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return per.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def with_heads(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The conversations with their first `head` (1 to `most`, or 0) turns replaced by as many first turns of conversation `base`, all if it has fewer, none if it is absent.

    base and head are made of conv_id, and a base is its own base, so only bases'
    first turns are joined.
    """
    heads = convs.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    rows = convs.withColumns({"base": base, "h": head}).join(heads, "base", "left")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(convs.schema["turns"].dataType))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(first, own).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """conv_id, path (a digest a step), words."""
    of = lambda c: F.transform("turns", lambda x: x[c])
    return convs.select("conv_id", F.unhex(F.array_join(of("digest"), "")).alias("path"), of("words").alias("words"))


class Skeleton:
    """The trie of the splitters' paths: steps from a node (0 is the root) to its children, and their depths; travels to the tasks."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = splitters
        self.next: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            at = 0
            for k in range(0, len(path), STEP):
                key = at, path[k : k + STEP]
                if key not in self.next:
                    self.next[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(k // STEP + 1)
                at = self.next[key]


def choose_splitters(rows: DataFrame) -> list[tuple[bytes, int]]:
    """Splitters that deal the paths into shards of about SHARD_BYTES, at least one for each shuffle partition.

    A sample of a fixed number of paths a shard, by hash, is sorted and thinned
    out inside Spark. A splitter need not be a whole path: each is cut at its
    share of SKELETON_BYTES, which bounds what is collected and broadcast.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("path").cast("long") + 32)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    cut = max(1, SKELETON_BYTES // shards // STEP) * STEP
    short = rows.select(F.substring("path", 1, cut).alias("path"), "conv_id")
    sample = stored(short.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLED), "sample")
    step = max(1, sample.count() // shards)
    ordered = sample.repartition(1).sortWithinPartitions("path", "conv_id").withColumn("k", F.monotonically_increasing_id())
    return [(bytes(r.path), r.conv_id) for r in ordered.where((F.col("k") > 0) & (F.col("k") % step == 0)).select("path", "conv_id").collect()]


class Node:
    """An open node of a shard's walk."""

    __slots__ = ("step", "skeleton", "words", "least", "n", "children", "leaves", "saved", "ids", "sha", "rows")

    def __init__(self, step: bytes, skeleton: int, words: int) -> None:
        self.step, self.skeleton, self.words = step, skeleton, words
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.sha, self.rows = [], None, []


class Walk:
    """One shard's sorted paths, walked with a stack of open nodes; finished rows gather in `out`.

    Rows wait at their parent until its least member is known. Children of
    skeleton nodes go out with the skeleton's number instead.
    """

    def __init__(self, skeleton: Skeleton, shard: int) -> None:
        self.skeleton, self.shard, self.out, self.held = skeleton, shard, [], 0
        self.stack, self.path, self.blocks = [Node(b"", 0, 0)], b"", 0

    def take(self, conv_id: int, path: bytes, words: list[int]) -> None:
        stack, depth = self.stack, 0
        if path != self.path:
            most = min(len(path), len(self.path)) // STEP
            while depth < most and path[depth * STEP : depth * STEP + STEP] == stack[depth + 1].step:
                depth += 1
            while len(stack) - 1 > depth:
                self.close()
            at = stack[-1].skeleton
            for k in range(depth, len(path) // STEP):
                step = path[k * STEP : k * STEP + STEP]
                at = self.skeleton.next.get((at, step), -1) if at >= 0 else -1
                stack.append(Node(step, at, words[k]))
            self.path = path
        node = stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None or conv_id < node.least else node.least
        node.ids.append(conv_id)
        if len(node.ids) >= ROWS:
            self.hash(node)

    def hash(self, node: Node) -> None:
        """Takes the gathered ids of a node into its hash, or for the skeleton into blocks."""
        if not node.ids:
            return
        text = ",".join(map(str, node.ids)).encode()
        if node.skeleton < 0:
            text = text if node.sha is None else b"," + text
            node.sha = node.sha or hashlib.sha256()
            node.sha.update(text)
        else:
            for k in range(0, len(text), BLOCK):  # a comma stands before every shard's first block but a node's very first
                self.out.append((None,) * 8 + (node.skeleton, self.shard, None, self.blocks, b"," * (k == 0) + text[k : k + BLOCK]))
                self.blocks += 1
            self.held += len(text)
        node.ids = []

    def close(self) -> None:
        node = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        self.hash(node)
        if node.skeleton >= 0:
            self.out.append((node.least, depth, None, node.n, node.children, node.leaves, node.saved, None, node.skeleton, self.shard, node.words, -1, None))
            return
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        self.out += [(r[0], r[1], node.least, *r[3:]) for r in node.rows]
        sha = (node.sha or hashlib.sha256()).hexdigest()
        row = (node.least, depth, None, node.n, node.children, node.leaves, node.saved, sha, None if above.skeleton < 0 else above.skeleton, self.shard, None, None, None)
        (above.rows if above.skeleton < 0 else self.out).append(row)
        above.n += node.n
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved

    def end(self) -> None:
        while self.stack:
            self.close()


def walked(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """OUT rows of all shards. Finished nodes have ends_sha256 (and, where their parent is of the skeleton, its number); partial aggregates of skeleton nodes have block -1; blocks of their ids have `ids`."""
    shared = rows.sparkSession.sparkContext.broadcast(skeleton)
    shards = len(skeleton.splitters) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value.splitters
        for b in batches:
            shard = [bisect_right(splitters, key) for key in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)
        for b in batches:
            for shard, conv_id, path, words in zip(*[b.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words")], strict=True):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.end()
                        yield out(now.out)
                    now = Walk(shared.value, shard)
                now.take(conv_id, path, words)
                if len(now.out) >= ROWS or now.held >= 8 * BLOCK:
                    yield out(now.out)
                    now.out, now.held = [], 0
        if now is not None:
            now.end()
            yield out(now.out)

    dealt = rows.select("conv_id", "path", "words").mapInArrow(deal, "shard int, conv_id long, path binary, words array<long>")
    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'binary' if f.type == pa.binary() else 'long'}" for f in OUT)
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walk, schema)


def hashed_blocks(blocks: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: each node's blocks hashed in order of shard and block, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for b in batches:
            for node, ids in zip(b.column("skeleton").to_pylist(), b.column("ids"), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                    sha.update(ids.as_py()[1:])  # without the comma
                else:
                    sha.update(ids.as_py())
        if now is not None:
            out.append((now, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["skeleton", "ends_sha256"])

    rows = blocks.select("skeleton", "shard", "block", "ids").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "block")
    return rows.mapInArrow(run, "skeleton long, ends_sha256 string")


def folded(found: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """NODE and ends_sha256 of the skeleton's nodes, with their numbers: partial aggregates added up over shards, then along the skeleton, whose size is bounded."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.where("block = -1").groupBy("skeleton").agg(F.min("conv_id").alias("least"), F.max("words").alias("words"), *sums)
    hashes = {r.skeleton: r.ends_sha256 for r in hashed_blocks(found.where("ids is not null")).collect()}
    least, n, children, leaves, saved, words = ({} for _ in range(6))
    for r in parts.collect():
        k = r.skeleton
        least[k], n[k], children[k], leaves[k], saved[k], words[k] = r.least, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.words
    for k in range(len(skeleton.parent) - 1, -1, -1):  # children have greater numbers than their parents
        if k not in n:
            continue
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * words[k]
        if (up := skeleton.parent[k]) in n:
            n[up] += n[k]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
            least[up] = least[k] if least[up] is None else least[up] if least[k] is None else min(least[up], least[k])
    none = hashlib.sha256().hexdigest()
    return [(least[k], skeleton.depth[k], least.get(skeleton.parent[k]), n[k], children[k], leaves[k], saved[k], hashes.get(k, none), k) for k in sorted(n) if n[k]]


def prefix_trie(convs: DataFrame) -> DataFrame:
    """NODE and ends_sha256: one row per node of the trie of conversations (conv_id, turns as ordered_turns gives them)."""
    spark = convs.sparkSession
    rows = stored(paths(convs), "paths")
    skeleton = Skeleton(choose_splitters(rows))
    found = stored(walked(rows, skeleton), "nodes")
    schema = ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string, skeleton long"
    top = spark.createDataFrame(folded(found, skeleton), schema)
    names = top.select("skeleton", F.col("conv_id").alias("above"))
    below = found.where("ends_sha256 is not null").join(F.broadcast(names), "skeleton", "left")  # names: nodes of the skeleton
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return below.select(*NODE, "ends_sha256").unionByName(top.select(*NODE, "ends_sha256"))


def op11_splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = ordered_turns(table(spark, sf_dir, "conversations"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie(with_heads(convs, F.expr("conv_id - conv_id % 20"), head, 3))
