"""Byte-level BPE as recursive SQL, one DuckDB per Spark partition.

A batch's words that are not yet known become token-position rows. Each step
of the recursion joins neighbouring tokens with the merge table and contracts,
in every word, the leftmost pair of least rank, until no word has a pair left;
an ordered aggregation turns the rows into ids. Where no longer token containing
the merged one has a lower rank, the later pairs of the same rank would be next
in turn, and the step contracts them too, so runs of one character take few steps.

A long word is encoded in overlapping chunks. No merge crosses the border of
two tokens of a finished encoding, and whether a border holds depends on its two
tokens alone; so where two chunks' encodings have one token in common, the left
one up to it and the right one after it are the encoding of both. Chunks without
a common token are encoded again as longer ones, at last the word as a whole.
The recursion keeps every step, so long words take bounded numbers of steps a
query, each going on from the last state of the one before.

Decoding starts from the emitted ids: token-position rows of every document
join the token table, and an ordered aggregation puts their bytes together.

Defined results: null and empty texts have no tokens (hashes of nothing);
special strings are ordinary text; texts and words of any length are encoded
whole; repeated rows repeat; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from casewise.llm.common import table

CACHE = 1_000_000
STEP_BYTES = 400_000
#: Words up to this many bytes contract one pair a step; longer ones contract every safe repeat of it.
SHORT = 48
#: Bytes of a chunk of a long word and of what it shares with the next; rows that a query over long words may keep; token rows decoded at once.
CHUNK, OVERLAP = 128, 64
KEPT_ROWS = 4_000_000
DECODED_ROWS = 1_000_000
STEPS = """
with recursive state as (
  select word, g, nxt, tok, 0 as step from start
  union all
  (
    with pair as (
      select p.word, p.g, q.g as g2, q.nxt as nxt2, m.merged, m.safe
      from state p join state q on p.nxt = q.g join merges m on m.ab = p.tok::bigint * 65536 + q.tok
    ), {best}
    select s.word, s.g, case when t.g is null then s.nxt else t.nxt2 end, case when t.g is null then s.tok else t.merged end, s.step + 1
    from state s join (select distinct word from take) w using (word) left join take t on s.g = t.g
    where s.g not in (select g2 from take) and s.step < {limit}
  )
), last as (
  select s.* from state s join (select word, max(step) as step from state group by word) using (word, step)
)
"""
#: The leftmost pair of least rank in each word.
ONE = STEPS.format(limit="$steps", best="""least as (
      select word, min(merged::bigint * 4294967296 + g) as k from pair group by word
    ), take as (
      select p.* from pair p join least l on p.word = l.word and p.merged::bigint * 4294967296 + p.g = l.k
    )""") 
IDS = "select word, string_agg(cast(tok as varchar), ',' order by g) as ids from last group by word"
STATE = "select word, g, nxt, tok, step from last order by g"
#: The same and, where that is what the next steps would do, the later pairs of that rank: every second one of a run that overlaps.
ALL = STEPS.format(limit="$steps", best="""hit as (
      select * from pair qualify merged = min(merged) over (partition by word)
    ), run as (
      select *, sum(fresh) over (partition by word order by g) as run
      from (select *, case when g = lag(g2) over (partition by word order by g) then 0 else 1 end as fresh from hit)
    ), take as (
      select * from run
      qualify case when safe then row_number() over (partition by word, run order by g) % 2 = 1
                   else row_number() over (partition by word order by g) = 1 end
    )""")
#: Bytes of each run of tokens, in order: one thread aggregates the rows as they come.
DECODE = "select run, unhex(string_agg(hex, '')) from (select run, hex from ids join tokens using (tok) order by run, nth) group by run"


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[tuple], set[int]]:
    """(left, right, merged) ranks of every way to join two tokens into one, and the merged ranks that are not safe to repeat."""
    rows, unsafe = [], set()
    for whole, r in ranks.items():
        for i in range(1, len(whole)):
            a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
            if a is not None and b is not None:
                rows.append((a, b, r))
                unsafe |= {x for x in (a, b) if x > r}
    return rows, unsafe


class Encoder:
    """Encodes words through DuckDB; what it has encoded stays in a bounded cache for the partitions that follow in this worker."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rows, unsafe = merge_rows(ranks)
        a, b, m = np.asarray(rows, np.int32).T
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.con.register("m", pa.table({"ab": a.astype(np.int64) * 65536 + b, "merged": m, "safe": np.asarray([x not in unsafe for x in m.tolist()])}))
        self.con.execute("create table merges as select * from m")
        self.ranks = ranks
        self.con.register("t", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": [x.hex() for x in ranks]}))
        self.con.execute("create table tokens as select * from t")
        self.bytes = np.asarray([ranks[bytes([x])] for x in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.split, self.cache, self.words = regex.compile(pattern), {}, {}

    def _rows(self, words: list[bytes]) -> pa.Table:
        """Token-position rows of these words, a token a byte."""
        lens = np.asarray([len(w) for w in words])
        nxt = np.arange(1, lens.sum() + 1)
        nxt[np.cumsum(lens) - 1] = -1
        tok = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        return pa.table({"word": np.repeat(np.arange(len(words)), lens), "g": np.arange(len(tok)), "nxt": nxt, "tok": tok})

    def _query(self, sql: str, start: pa.Table, **parameters: int):
        self.con.register("start", start)
        try:
            return self.con.execute(sql, parameters or None).fetchnumpy()
        finally:
            self.con.unregister("start")

    def _encode(self, words: list[str]) -> dict[str, str]:
        """Ids of each word of this list, by one recursive query for about STEP_BYTES bytes of words at a time; whole tokens need none."""
        out, raw, rest = {}, {}, []
        for w in words:
            if (tok := self.ranks.get(x := w.encode())) is not None:
                out[w] = str(tok)
            elif len(x) <= SHORT:
                raw[w] = x
                rest.append(w)
            else:
                out[w] = ",".join(map(str, self._encode_long(x)))
        k = 0
        while k < len(rest):
            end, size = k, 0
            while end < len(rest) and size < STEP_BYTES:
                size, end = size + len(raw[rest[end]]), end + 1
            found = self._query(ONE + IDS, self._rows([raw[w] for w in rest[k:end]]), steps=SHORT)
            out.update(zip([rest[k + w] for w in found["word"].tolist()], found["ids"], strict=True))
            k = end
        return out

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of these words, by queries of so many steps that KEPT_ROWS rows are kept at most."""
        out: list = [None] * len(words)
        start = self._rows(words)
        while start.num_rows:
            steps = max(4, KEPT_ROWS // start.num_rows)
            found = self._query((ONE if start.num_rows <= 4 * CHUNK * len(words) else ALL) + STATE, start, steps=steps)
            done = found["step"] < steps
            word, tok = found["word"][done], found["tok"][done]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            for w, end, begin in zip(word[first].tolist(), np.append(first, len(word))[1:].tolist(), first.tolist(), strict=True):
                out[w] = tok[begin:end]
            start = pa.table({c: found[c][~done] for c in ("word", "g", "nxt", "tok")})
        return out

    def _encode_long(self, word: bytes) -> list[int]:
        """Ids of a long word, from the encodings of its chunks; equal chunks are encoded once.

        Where a chunk has no token in common with the one before, it is encoded
        again from a border of that one's tokens, further back each time.
        """
        cuts = [(a, min(len(word), a + CHUNK + OVERLAP)) for a in range(0, max(1, len(word) - OVERLAP), CHUNK)]
        new, codes = list({word[a:b] for a, b in cuts}), {}
        for k in range(0, len(new), STEP_BYTES // 4 // CHUNK):
            part = new[k : k + STEP_BYTES // 4 // CHUNK]
            codes.update(zip(part, self._contract(part), strict=True))
        out = codes[word[: cuts[0][1]]].tolist()
        ends = np.cumsum(self.size[out]).tolist()
        for a, b in cuts[1:]:
            back = OVERLAP
            while True:
                if word[a:b] not in codes:
                    codes[word[a:b]] = self._contract([word[a:b]])[0]
                right = codes[word[a:b]]
                to = a + np.cumsum(self.size[right])
                since = bisect_right(ends, a)
                _, x, y = np.intersect1d(ends[since:], to, assume_unique=True, return_indices=True)
                same = np.flatnonzero(np.asarray(out[since:])[x] == right[y])
                if a == 0 or len(same):
                    break
                border = bisect_right(ends, a - back)
                a, back = ends[border - 1] if border else 0, back * 2
            keep, skip = (since + x[same[0]] + 1, y[same[0]] + 1) if len(same) else (0, 0)
            out[keep:], ends[keep:] = right[skip:].tolist(), to[skip:].tolist()
        return out

    def decode(self, ids: list[str]) -> list[bytes]:
        """The bytes of each text, from its ids as decimals joined by commas."""
        counts = np.asarray([x.count(",") + 1 if x else 0 for x in ids], np.int64)
        tok = np.fromstring(",".join([x for x in ids if x]), np.int32, sep=",")
        doc = np.repeat(np.arange(len(ids)), counts)
        nth = np.arange(len(tok)) - np.repeat(np.cumsum(counts) - counts, counts)
        out: list = [[] for _ in ids]
        for k in range(0, len(tok), DECODED_ROWS):
            run = doc[k : k + DECODED_ROWS]
            self.con.register("ids", pa.table({"run": run, "nth": nth[k : k + DECODED_ROWS], "tok": tok[k : k + DECODED_ROWS]}))
            for d, found in self.con.execute(DECODE).fetchall():
                out[d].append(found)
            self.con.unregister("ids")
        return [b"".join(x) for x in out]

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimals joined by commas.

        A text without double spaces is split at its spaces first: no match of
        the pattern reaches across one from the left.
        """
        units = [[x for x in t.replace(" ", "\0 ").split("\0") if x] if "  " not in t and "\0" not in t else self.split.findall(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        if len(self.words) > CACHE:
            self.words = {}
        cache, known = self.cache, self.words
        new = {u for us in units for u in us}.difference(cache)
        parts = {u: [u] if (x := u.removeprefix(" ")).isascii() and x.isalpha() else self.split.findall(u) for u in new}
        known.update(self._encode(list({w for ws in parts.values() for w in ws if w not in known})))
        for u, ws in parts.items():
            cache[u] = ",".join([known[w] for w in ws])
        out = [",".join([cache[u] for u in us]) for us in units]
        for u in new:  # long ones don't stay
            if len(u) > 64:
                for w in parts[u]:
                    known.pop(w, None)
                del cache[u]
        return out


@functools.cache
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, and the digests ids_sha256 and decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            ids, texts, k = batch.column(0), [x or "" for x in batch.column(1).to_pylist()], 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and (end == k or size + len(texts[end]) <= batch_chars):
                    size, end = size + len(texts[end]), end + 1
                coded = enc.encode(texts[k:end])
                decoded = enc.decode(coded)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(k, end - k),
                    pa.array([x.count(",") + (x > "") for x in coded], pa.int64()),
                    pa.array(coded, pa.string()),
                    pa.array(decoded, pa.binary()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ], names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])
                k = end

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
