"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each partition packs its own pieces online, in order of arrival, with a fixed
number of open bins. The open bins stand in a bitset keyed by free space, so the
tightest fit is one shift and one lowest-bit step; when all are open and none
fits, the fullest closes first. Bins still open at a partition's end (at most
``open_bins`` each) go through the same packing once more, as pieces of their
own, in groups of bounded size.

Defined results: null and empty texts are the end id alone; documents longer
than a sequence are cut, first piece shorter, whatever their length; of bins
with the same free space (ties) the one used last is taken; repeated rows are
packed as often as they occur; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import stored, table

SPECIAL = "<|endoftext|>"
CACHE = 400_000
#: A space after other white space.
AFTER_SPACE = re.compile(r"[^\S ] ")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open_used int"


@functools.cache
def encoder(json_path: str, ranks_path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit bytes, as ``tokenizers`` gives them without special tokens added.

    The rank file holds the same vocabulary, so ordinary text goes through it;
    texts that spell the special token go through the JSON tokenizer. No match
    of the split pattern crosses into a space from a character that is no white
    space, so a text in which no space follows white space is encoded by space-led
    words, from a bounded cache.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = lambda s: np.asarray(plain.encode_ordinary(s), np.uint32).astype("<u4").tobytes()
    special: list = []

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= CACHE:
                self.clear()
            found = raw(" " + word)
            if len(word) <= 64:
                self[word] = found
            return found

    words = Words()

    def encode(text: str) -> bytes:
        if SPECIAL in text:
            if not special:
                from tokenizers import Tokenizer

                special.append(Tokenizer.from_file(json_path))
            return np.asarray(special[0].encode(text, add_special_tokens=False).ids, np.uint32).astype("<u4").tobytes()
        if "  " in text or AFTER_SPACE.search(text):
            return raw(text)
        head, *rest = text.split(" ")
        return raw(head) + b"".join([words[w] for w in rest])

    return encode


class Bins:
    """Bounded-space online best-fit. put() gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0) -> None:
        self.capacity, self.limit, self.next = capacity, open_bins, first
        self.bits, self.by_free, self.open = 0, {}, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        if fits := self.bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.limit and size < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, free = self.next, self.capacity
            self.next += 1
        if left := free - size:
            self.by_free.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def rest(self) -> Iterator[tuple[int, int]]:
        """(bin, used) of the bins still open."""
        for free, stack in self.by_free.items():
            for b in stack:
                yield b, self.capacity - free


def pieces(documents: DataFrame, json_path: str, ranks_path: str, capacity: int, open_bins: int, end_id: int) -> DataFrame:
    """PIECES rows, one per piece; and for each bin left open at a partition's end one row with doc_id null and open_used."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("open_used", pa.int32())])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + tail)
                n, start = len(ids) // 4, 0
                for k in range(count := -(-n // capacity)):
                    end = n - capacity * (count - 1 - k)
                    out.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), *bins.put(end - start), None))
                    start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if left := list(bins.rest()):
            none = [None] * len(left)
            cols = [none, none, none, none, none, [b for b, _ in left], none, [u for _, u in left]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(pack, PIECES)


def merge_bins(left: DataFrame, capacity: int, open_bins: int, group: int = 50_000) -> DataFrame:
    """bin -> (into, shift): leftover bins packed into one another online, in groups of bounded size."""
    groups = -(-left.count() // group)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")  # partitions in turn: the same result when a task runs again
        bins, names, rows = Bins(capacity, open_bins), {}, []
        for b, used in zip(pdf["bin"].tolist(), pdf["open_used"].tolist(), strict=True):
            k, shift = bins.put(used)
            rows.append((b, names.setdefault(k, b), shift))
        return pd.DataFrame(rows, columns=["bin", "into", "shift"])

    keyed = left.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(max(groups, 1))))
    return keyed.groupBy("g").applyInPandas(pack, "bin long, into long, shift long")


def best_fit_pack(documents: DataFrame, json_path: str, ranks_path: str, capacity: int = 2048, open_bins: int = 64, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each document."""
    rows = stored(pieces(documents, json_path, ranks_path, capacity, open_bins, end_id), "pieces")
    moves = stored(merge_bins(rows.where("open_used is not null").select("bin", "open_used"), capacity, open_bins), "moves")
    packed = rows.where("open_used is null").join(moves, "bin", "left")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
