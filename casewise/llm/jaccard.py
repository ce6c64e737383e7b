"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal sets of word shingles are one class. Classes that agree in a
band of MinHash values are candidates. Their values are then compared a few at
a time; after n comparisons with m agreements and a uniform prior, the
probability that the similarity reaches the threshold is
P(Binomial(n + 1, threshold) <= m), and a pair is dropped as soon as that
falls below the tolerance. What is left is verified on the whole shingle sets.

Pairs never become rows: candidates meet in groups (a band's value, split
into blocks where many classes share it), each pair is decided in the first
band it agrees in, and a group returns, per class, the number of documents it
links to and the least class it is connected with.

Bands: with four values each and 32 bands, two sets at similarity 0.8 miss
every band with a probability of 5e-8.

Defined results: a text of fewer than `words` words is one shingle, a text
without words (null, empty) links with nothing; repeated rows are documents of
one class, and so are texts under one doc_id with equal shingles; a null doc_id
is a member of its text's class and never its smallest, and classes whose ids
are all null are compared like any other (their class_id is null); texts of any
length are compared whole; an empty table gives no rows; further columns are
ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from casewise.llm.common import connected, stored, table
from casewise.llm.shingles import MinHash, mixed, shingles

BLOCK = 512
DENSE = 48_000_000


def least_agreements(checks: list[int], threshold: float, tolerance: float) -> list[int]:
    """For each number of comparisons the least number of agreements at which a pair stays."""
    out = []
    for n in checks:
        total, m = (1 - threshold) ** (n + 1), 0
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key per band of `rows` MinHash values, along the last axis."""
    v = values.astype(np.uint64).reshape(*values.shape[:-1], -1, rows)
    key = np.arange(v.shape[-2], dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[..., k])
    return key.view(np.int64)


def class_number(s: np.ndarray, doc_id: int | None) -> int:
    """A 64-bit name of the shingle set; texts without shingles are classes of their own."""
    raw = s.tobytes() if len(s) else f"none {doc_id}".encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


class Verifier:
    """Decides the pairs of one group."""

    def __init__(self, count: int, rows: int, threshold: float, tolerance: float, step: int = 16) -> None:
        self.rows, self.step, self.num, self.den = rows, step, round(threshold * 1000), 1000
        self.checks = list(range(step, count + 1, step))
        self.least = least_agreements(self.checks, threshold, tolerance)

    def candidates(self, sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (left, right) whose first common band is this one and that the comparison of values does not rule out."""
        keys = band_keys(sig[:, : band * self.rows], self.rows)  # what the groups were built from
        for k in range(band):
            new = keys[left, k] != keys[right, k]
            left, right = left[new], right[new]
        agree = np.zeros(len(left), np.int64)
        for n, least in zip(self.checks, self.least, strict=True):
            agree += (sig[left, n - self.step : n] == sig[right, n - self.step : n]).sum(axis=1)
            stay = agree >= least
            left, right, agree = left[stay], right[stay], agree[stay]
        return left, right

    def common(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections."""
        used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        if len(left) > 2 * len(used):
            terms, inverse = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
            if len(used) * len(terms) <= DENSE:
                has = np.zeros((len(used), len(terms)), np.float32)
                has[np.repeat(np.arange(len(used)), [len(sets[k]) for k in used]), inverse] = 1
                return (has @ has.T)[place[: len(left)], place[len(left) :]].round().astype(np.int64)
        return np.asarray([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)], np.int64)

    def links(self, sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.candidates(sig, left, right, band)
        if not len(left):
            return left, right
        size, both = np.asarray([len(s) for s in sets]), self.common(sets, left, right)
        ok = both * self.den >= self.num * (size[left] + size[right] - both)
        return left[ok], right[ok]


def _roots(n: int, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each of n members is connected with."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, left, low[right])
        np.minimum.at(new, right, low[left])
        if (new == low).all():
            return low
        low = new


def near_duplicates(documents: DataFrame, threshold: float = 0.8, words: int = 5, count: int = 128, rows: int = 4, tolerance: float = 1e-6, bin_bytes: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept, component, and the columns of `carry`: one row per document.

    class_id is the least doc_id with the same shingles, n_links the number of
    other documents with similarity of at least `threshold`, component_id the
    least doc_id that links lead to, kept whether the row is that document;
    component names the group even where doc_ids are null or stand twice.
    """
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("mark"), *carry)
    carried = to_arrow_schema(texts.select(*carry).schema)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(count)
        for b in batches:
            c, bands = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), words)
                c.append(class_number(s, doc_id))
                bands.append(band_keys(minhash(s), rows) if len(s) else np.empty(0, np.int64))
            columns = [b.column(0), b.column(2), pa.array(c, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *b.columns[3:]], names=["doc_id", "mark", "c", "bands", *carried.names])

    result = StructType.fromDDL("doc_id long, mark long, c long, bands array<long>")
    for name in carry:
        result = result.add(texts.schema[name])
    meta = stored(texts.mapInArrow(describe, result), "shingles")
    # the row that stands for a class: one with its least doc_id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("class_id"), "mark")).alias("first")
    classes = meta.groupBy("c").agg(first, F.count("*").alias("size"), F.any_value("bands").alias("bands"))
    classes = stored(classes.select("c", "first.class_id", "first.mark", "size", "bands"), "classes")

    keyed = classes.select("c", F.posexplode("bands").alias("band", "key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(full, "key"), "bands")
    # classes that share a value: one list where they are few, the same list from several bands once
    few = shared.where(f"n <= {BLOCK}").groupBy("key").agg(F.min("band").alias("band"), F.array_sort(F.collect_list("c")).alias("list"))
    few = few.groupBy("list").agg(F.min("band").alias("band"), F.min("key").alias("key")).select("key", "band", F.explode("list").alias("c"), F.lit(0).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    # and blocks where they are many, each block with itself and every other
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = shared.where(f"n > {BLOCK}").withColumn("b", F.pmod(F.xxhash64("c", "key"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j"), (F.col("b") > x).cast("int").alias("side")))
    many = many.select("key", "band", "c", F.explode(pairs).alias("p")).select("key", "band", "c", "p.side", "p.i", "p.j")
    groups = stored(few.unionByName(many), "groups")

    def describe_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(count)
        for b in batches:
            out = []
            for c, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), words)
                if class_number(s, None) == c and len(s):
                    out.append((c, minhash(s).astype("<u4").tobytes(), s.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["c", "sig", "terms"])

    needed = classes.join(groups.select("c").distinct(), "c").select("c", "class_id", "mark", "size")
    of_class = (F.coalesce(texts.doc_id, F.lit(-1)) == F.coalesce(needed.class_id, F.lit(-1))) & (texts.mark == needed.mark)
    sets = texts.join(needed, of_class).select("c", "text").mapInArrow(describe_sets, "c long, sig binary, terms binary")
    sets = stored(needed.select("c", "size").join(sets.dropDuplicates(["c"]), "c"), "sets")
    weight = groups.join(sets.select("c", F.octet_length("terms").alias("w")), "c").agg(F.sum(F.col("w") + count * 4)).first()[0] or 0
    bins = int(max(8, -(-weight // bin_bytes)))
    verifier = Verifier(count, rows, threshold, tolerance)

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by([(k, "ascending") for k in ("key", "i", "j", "side", "c")])
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, count)
        terms = [np.frombuffer(x, "<u8") for x in t.column("terms").to_pylist()]
        ids, size, band = (np.asarray(t.column(k).to_pylist(), np.int64) for k in ("c", "size", "band"))
        name = list(zip(*(t.column(k).to_pylist() for k in ("key", "i", "j")), strict=True))
        side = np.asarray(t.column("side").to_pylist(), np.int64)
        out: dict = {"c": [], "links": [], "root": []}
        a = 0
        while a < len(name):
            b = a
            while b < len(name) and name[b] == name[a]:
                b += 1
            n, s = b - a, side[a:b]
            left, right = np.triu_indices(n, 1) if name[a][1] == name[a][2] else np.nonzero((s[:, None] == 0) & (s[None, :] == 1))
            left, right = verifier.links(sig[a:b], terms[a:b], left, right, int(band[a]))
            if len(left):
                count_ = np.bincount(left, size[a:b][right], n) + np.bincount(right, size[a:b][left], n)
                root = _roots(n, left, right, ids[a:b])
                hit = np.flatnonzero(count_)
                out["c"] += ids[a:b][hit].tolist()
                out["links"] += count_[hit].astype(np.int64).tolist()
                out["root"] += root[hit].tolist()
            a = b
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    dealt = groups.join(sets, "c").withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bins)))
    found = stored(dealt.groupBy("bin").applyInArrow(verify, "c long, links long, root long"), "links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    parts = stored(connected(found, "c", "root").select(F.col("id").alias("c"), F.col("component_id").alias("component")), "parts")
    low = parts.join(classes.select("c", "class_id"), "c").groupBy("component").agg(F.min("class_id").alias("component_id"))
    per_class = classes.select("c", "class_id", "size").join(links, "c", "left").join(parts, "c", "left").join(low, "component", "left")
    out = meta.select("doc_id", "c", *carry).join(per_class, "c")
    own = F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"), F.coalesce("component", "c").alias("component"), *carry,
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
