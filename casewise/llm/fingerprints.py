"""Document fingerprints from prefix polynomial hashes.

prefix[i] is the sum of code[j] * base^j modulo a prime for j < i, so any span's
hash is a difference of two entries, any two spans compare in constant time,
and the longest common extension of two positions is a binary search. The
fingerprint of a text is its length, its whole hash under two bases, and for
each of 64 classes of span hashes the least member: equal slots estimate the
share of common spans. Texts of fewer than 256 code points have the least
members of short spans too, by which two such texts are compared: an edit leaves
few long spans of a short text whole.

Defined results: null is the empty text; two empty texts are alike (1.0), an
empty and a non-empty one are not (0.0); texts shorter than a span are one
span; texts of any length are hashed whole, a block of spans at a time; equal
texts (ties) have equal fingerprints; rows with equal doc_id follow one another in order of their text's hash;
a null doc_id comes last; one row alone is its own next document; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import table

PRIME = (1 << 31) - 1
BASES = (1_000_003_579, 748_932_203)
SPAN, SLOTS, BLOCK = 32, 64, 1 << 18
#: The span for texts of fewer code points than SHORT_TEXT.
SHORT_SPAN, SHORT_TEXT = 4, 256
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
BUCKET_LIMIT = 4096


class Powers:
    """Powers of a base and of its inverse modulo PRIME, extended as longer texts come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, PRIME)) % np.uint64(PRIME)])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, PRIME)) % np.uint64(PRIME)])


POWERS = tuple(Powers(b) for b in BASES)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix arrays of a text; with `like` and `keep`, the first `keep` entries are taken over from another text's arrays."""

    def __init__(self, code: np.ndarray, like: Prefix | None = None, keep: int = 0) -> None:
        self.n, self.sums = len(code), []
        for k, p in enumerate(POWERS):
            p.reach(self.n)
            new = np.cumsum((code[keep:].astype(np.uint64) + np.uint64(1)) * p.up[keep : self.n] % np.uint64(PRIME))
            head = like.sums[k][: keep + 1] if like is not None else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([head, (new + head[-1]) % np.uint64(PRIME)]))

    def span(self, i: int, length: int) -> tuple[int, ...]:
        """The hash of text[i : i + length], the same wherever that string stands."""
        return tuple((int(s[i + length]) - int(s[i])) * int(p.down[i]) % PRIME for s, p in zip(self.sums, POWERS, strict=True))

    def equal(self, i: int, other: Prefix, j: int, length: int) -> bool:
        return self.span(i, length) == other.span(j, length)

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common extension of text[i:] and other[j:], by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def least(self, start: int, end: int, span: int = SPAN) -> np.ndarray:
        """For each slot the least mixed hash of the spans that begin in [start, end)."""
        out, s, p = np.full(SLOTS, EMPTY), self.sums[0], POWERS[0]
        for a in range(max(0, start), end, BLOCK):
            b = min(end, a + BLOCK)
            h = (s[a + span : b + span] + np.uint64(PRIME) - s[a:b]) % np.uint64(PRIME) * p.down[a:b] % np.uint64(PRIME)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h.sort()
            first = np.searchsorted(h, np.arange(SLOTS, dtype=np.uint64) << np.uint64(58))
            ends = np.append(first[1:], len(h))
            got = np.where(first < ends, h[np.minimum(first, len(h) - 1)], EMPTY)
            out = np.minimum(out, got)
        return out

    def sketch(self, span: int = SPAN) -> np.ndarray:
        if self.n == 0:
            return np.full(SLOTS, EMPTY)
        return self.least(0, max(1, self.n - span + 1), min(span, self.n))


def slots(sketch: np.ndarray) -> str:
    return "".join("...." if x == EMPTY else f"{int(x) >> 20 & 0xFFFF:04x}" for x in sketch)


def written(p: Prefix, sketch: np.ndarray) -> str:
    """length, whole hash, and four hexadecimal digits for each slot, .... where a slot has no span; for a short text the slots of short spans too."""
    whole = "".join(f"{x:08x}" for x in p.span(0, p.n))
    short = f"-{slots(p.sketch(SHORT_SPAN))}" if p.n < SHORT_TEXT else ""
    return f"{p.n:x}-{whole}-{slots(sketch)}{short}"


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints: 1 where they are equal, else the share of equal slots among those either fills; of short spans where both have them."""
    if a == b:
        return 1.0
    x, y = (f.split("-")[2:] for f in (a, b))
    k = min(len(x), len(y)) - 1
    x, y = x[k], y[k]
    pairs = [(x[k : k + 4], y[k : k + 4]) for k in range(0, 4 * SLOTS, 4)]
    filled = [p for p in pairs if p != ("....", "....")]
    return sum(p[0] == p[1] for p in filled) / len(filled) if filled else 0.0


def edited(text: str, after: str) -> tuple[str, int]:
    """The text with its last third replaced by the start of the next one; and how many code points stay."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k], len(text) - k


def _followed(documents: DataFrame, bucket_bytes: int) -> DataFrame:
    """Rows dealt by ranges of doc_id (descending inside), each range followed by the first row of the next as a guest."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("oid"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(BUCKET_LIMIT, max(32, size // bucket_bytes)))
    ids = rows.select("oid")
    cuts = sorted(set(ids.withColumn("d", F.col("oid").cast("double")).approxQuantile("d", [k / n for k in range(1, n)], 0.2 / n)))
    rows = rows.withColumn("d", F.col("oid").cast("double"))
    rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="d", outputCol="b").transform(rows) if cuts else rows.withColumn("b", F.lit(0.0))
    rows = rows.select("doc_id", "text", "oid", F.col("b").cast("int").alias("bucket"), F.xxhash64("text").alias("h"))
    tops = sorted(((r.bucket, r.top.oid, r.top.h) for r in rows.groupBy("bucket").agg(F.max(F.struct("oid", "h")).alias("top")).collect()), reverse=True)  # BUCKET_LIMIT rows at most
    to = [(oid, h, tops[k - 1][0]) for k, (_, oid, h) in enumerate(tops)]  # the first range's top follows the last range
    guests = spark.createDataFrame(to, "oid long, h long, target int")
    sent = rows.join(F.broadcast(guests), ["oid", "h"], "left")
    sent = sent.withColumn("place", F.explode(F.when(F.col("target").isNull(), F.array(F.struct("bucket", F.lit(0).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("guest"))))))
    sent = sent.select("place.*", "oid", "h", "doc_id", "text")
    return sent.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("oid"), F.desc("h"))


def fingerprint_edits(documents: DataFrame, bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix of every text.

    common_prefix is the longest common extension of the text and its edited
    form from their starts. One pass over sorted rows that holds two documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting = None, None

        def pair(a: tuple, b: tuple) -> tuple[list, str]:
            """a's result but for near_next, given the row that follows it; and a's fingerprint."""
            (_, _, doc_id, text, code, p), after = a, b
            changed, keep = edited(text, after[3])
            q = Prefix(np.concatenate([code[:keep], after[4][: len(code) - keep]]), p, keep)
            if min(p.n, q.n) >= SPAN:
                shared = max(0, keep - SPAN + 1)
                common = p.least(0, shared)
                s, t = np.minimum(common, p.least(shared, p.n - SPAN + 1)), np.minimum(common, q.least(shared, q.n - SPAN + 1))
            else:
                s, t = p.sketch(), q.sketch()
            mine, theirs = written(p, s), written(q, t)
            return [doc_id, p.n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mine, theirs, likeness(mine, theirs), None, p.extension(0, q, 0)], mine

        for batch in batches:
            out = []
            for bucket, guest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3)), strict=True):
                code = codes(text)
                now = (bucket, guest, doc_id, text, code, Prefix(code))
                if before is not None and before[0] == bucket and not before[1]:
                    row, mine = pair(before, now)
                    if waiting is not None:
                        waiting[6] = likeness(waiting[3], mine)
                        out.append(waiting)
                    waiting = row
                    if guest:
                        waiting[6] = likeness(mine, written(now[5], now[5].sketch()))
                        out.append(waiting)
                        waiting = None
                before = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"])

    rows = _followed(documents, bucket_bytes).select("bucket", "guest", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")


def op4_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
