"""Token counts by rank-synchronous array merging.

A batch's pre-tokens that are not yet known stand in ragged numpy arrays: one
array of symbols, one of the sequence each belongs to, one of the rank of every
neighbouring pair. A round takes the least rank of each sequence and contracts
all its pairs of that rank at once, in all sequences at once; of a run that
overlaps itself every second pair, from the left. Sequences without a pair left
are done, and what survives of them is counted. Contracting all pairs of a rank
together is what the one-by-one procedure does, since every merge makes a symbol
that only merges of higher rank use (checked when the file is read).

Pre-tokens longer than LONG bytes are merged in overlapping chunks, which join
where two neighbouring ones have a token in common, as in ``bpe``.

Defined results: null and empty texts have no tokens; special strings inside a
text are one token each, as the library reads them by default; texts and words
of any length are counted whole; repeated rows repeat; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from casewise.llm.bpe import Encoder
from casewise.llm.common import table

#: Units kept between batches; characters of texts, and bytes of pre-tokens, merged at once; bytes above which a pre-token is merged in chunks.
CACHE = 1_000_000
BATCH_CHARS = 4_000_000
MERGE_BYTES = 8_000_000
LONG = 256
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others in turn from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level BPE file of ``tokenizers``, and the counts of texts by it."""

    def __init__(self, json_path: str, pattern: str) -> None:
        with open(json_path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        plain = told["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        whole = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
        if model["type"] != "BPE" or not plain or not whole:
            raise ValueError(f"{json_path}: a byte-level BPE without normalizer, prefix space or stripping special tokens is needed")
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.asarray([ids[a + b] for a, b in pairs], np.int32)
        left, right = (np.asarray([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        byte = byte_symbols()
        self.bytes = np.zeros(256, np.int32)
        self.bytes[list(byte.values())] = [ids[c] for c in byte]
        self.size = np.zeros(max(ids.values()) + 1, np.int64)
        self.size[list(ids.values())] = [len(x) for x in ids]
        born = np.full(len(self.size), len(pairs), np.int64)
        born[self.bytes] = -1
        born[self.merged] = np.arange(len(pairs))
        if len(np.unique(self.merged)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{json_path}: a merge uses a symbol that a later one makes")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.first = self._rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)
        special = [t["content"] for t in told["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split, self.unsafe = regex.compile(pattern), regex.compile(r"\s[ ]")
        self.bare: dict[str, int] = {"": 0}
        self.led: dict[str, int] = {}

    #: The tokens of a long word from those of its chunks; takes size and _contract of this class.
    tokens_of_long = Encoder._encode_long

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sequences, their symbols) of words that are done, round by round; within one yield sequences are ascending, each with all its symbols."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        tok, seq = self.bytes[raw], np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(tok), NONE, np.int32)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.first[raw[inner], raw[inner + 1]]
        while len(tok):
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            lens = np.diff(starts, append=len(seq))
            least = np.minimum.reduceat(rank, starts)
            if (done := least == NONE).any():
                over = np.repeat(done, lens)
                yield seq[over], tok[over]
                tok, seq, rank = tok[~over], seq[~over], rank[~over]
                least, lens = least[~done], lens[~done]
                if not len(tok):
                    return
            hit = np.flatnonzero(rank == np.repeat(least, lens))
            fresh = np.diff(hit, prepend=-2) != 1  # the first of a run of overlapping pairs
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))) % 2 == 0]
            tok[hit] = self.merged[rank[hit]]
            keep = np.ones(len(tok), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # the new symbols' places
            tok, seq, rank = tok[keep], seq[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                rank[left] = NONE
                left = left[left + 1 < len(tok)]
                left = left[seq[left] == seq[left + 1]]
                rank[left] = self._rank(tok[left], tok[left + 1])

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word."""
        out: list = [np.zeros(0, np.int32)] * len(words)
        for seq, tok in self._merge(words):
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            for s, a, b in zip(seq[first].tolist(), first.tolist(), [*first[1:].tolist(), len(seq)], strict=True):
                out[s] = tok[a:b]
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each pre-token has."""
        out = np.zeros(len(words), np.int64)
        short, size = [], 0
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = len(self.tokens_of_long(w))
                continue
            short.append(k)
            size += len(w)
            if size > MERGE_BYTES:
                self._count(short, words, out)
                short, size = [], 0
        self._count(short, words, out)
        return out

    def _count(self, at: list[int], words: list[bytes], out: np.ndarray) -> None:
        n = np.zeros(len(at), np.int64)
        for seq, _ in self._merge([words[k] for k in at]):
            n += np.bincount(seq, minlength=len(at))
        out[at] = n

    def _units(self, text: str) -> tuple[list[str], list[str]]:
        """(units as they stand, units that a space leads, without it). No match of the pattern reaches into a space from a character that is no white space."""
        if "  " in text or self.unsafe.search(text):
            return self.split.findall(text), []
        head, *led = text.split(" ")
        return [head], led

    def _learn(self, cache: dict[str, int], units: set[str], lead: str) -> list[str]:
        """Counts of new units go into the cache; the long ones, which are not to stay there, are returned."""
        units = list(units)
        parts = [[lead + u] if u.isascii() and u.isalpha() else self.split.findall(lead + u) for u in units]
        words = list({w for p in parts for w in p})
        n = dict(zip(words, self.words([w.encode() for w in words]).tolist(), strict=True))
        cache.update({u: sum([n[w] for w in p]) for u, p in zip(units, parts, strict=True)})
        return [u for u in units if len(u) > 64]

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about BATCH_CHARS that have the pre-tokens of the whole."""
        a = 0
        while len(text) - a > BATCH_CHARS:
            found = self.border.search(text, a + BATCH_CHARS)
            if not found:
                break
            yield text[a : found.end()]
            a = found.end()
        yield text[a:]

    border = regex.compile(r"[\p{L}\p{N}](?=[ ])")

    def count(self, texts: list[str]) -> list[int]:
        """How many tokens each text has."""
        extra, units = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            units.append([self._units(piece) for p in parts for piece in self.pieces(p)])
        for cache in (self.bare, self.led):
            if len(cache) > CACHE:
                cache.clear()
                self.bare[""] = 0
        long = []
        for k, (cache, lead) in enumerate(((self.bare, ""), (self.led, " "))):
            new = set().union(*[u[k] for us in units for u in us]).difference(cache)
            long.append(self._learn(cache, new, lead))
        get = [cache.__getitem__ for cache in (self.bare, self.led)]
        out = [e + sum([sum(map(g, part)) for u in us for g, part in zip(get, u, strict=True)]) for e, us in zip(extra, units, strict=True)]
        for cache, some in zip((self.bare, self.led), long, strict=True):
            for u in some:
                del cache[u]
        return out


@functools.cache
def merges(json_path: str, pattern: str) -> Merges:
    return Merges(json_path, pattern)


def token_counts(documents: DataFrame, json_path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merges(json_path, pattern)
        for batch in batches:
            texts, n, size, part = batch.column(1), [], 0, []
            for x in texts:
                part.append(x.as_py() or "")
                size += len(part[-1])
                if size > BATCH_CHARS:
                    n, part, size = n + own.count(part), [], 0
            n += own.count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = "coalesce(cast(octet_length(text) as bigint), 0L) as n_bytes"
    return documents.selectExpr("doc_id", "text", size).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op12_array_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
