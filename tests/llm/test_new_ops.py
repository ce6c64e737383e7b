"""Operators 11 to 13 against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from casewise.llm import counts, tries, whitening

CLASH = ("path", "words", "shard", "base", "h", "first", "t", "n", "dims", "part", "state", "component", "n_bytes", "level_0")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, role or "", text or ""))
    conv = {c: [k[2:] for k in sorted(v, key=lambda k: k[:2])] for c, v in conv.items()}
    rebuilt = {}
    for c, turns in conv.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = conv.get(base, [])[:h] + turns[h:]
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(rebuilt):
        p = tuple(rebuilt[c])
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(kids[p]), leaves[p], saved[p], digest(p)) for p in members)


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


def trie(spark, tmp_path, rows):
    clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return found(tries.op11_splitter_skeleton(spark, str(tmp_path)))


def conversations():
    rng, rows = random.Random(3), []
    for c in [*range(-45, 400), 10**12]:
        kind = rng.choice(("copy", "own", "short", "chain"))
        for k in range({"copy": 4, "own": rng.randint(1, 6), "short": 1, "chain": 7}[kind]):
            text = {"copy": f"same {k} words", "own": f"own {rng.randint(0, 2)}\t{k}", "short": "x\n y", "chain": f"chain {k if k < 6 else c}"}[kind]
            rows.append((c, k, rng.choice(("user", "user", None)), text))
    rows = [r for r in rows if r[0] not in (40, 41)]
    rows += [(41, 0, "user", "x"), (500, None, None, None), (500, 0, "a", None), (500, 1, None, "é b  c"), (None, 0, "user", "lost"), (501, 5, "u", "w " * 200_000)]
    rows += [(502, 1, "u", "twice"), (502, 1, "u", "twice"), (503, 0, "u", "t0")]
    return rows + [(504, k, "u", f"t{k}") for k in range(700)] + [(505, k, "u", f"t{k}") for k in range(699)]


def test_trie(spark, tmp_path):
    rows = conversations()
    assert trie(spark, tmp_path / "a", rows) == brute_trie(rows)
    assert trie(spark, tmp_path / "b", []) == []
    assert trie(spark, tmp_path / "c", [(7, 1, "u", "one")]) == brute_trie([(7, 1, "u", "one")])


def test_trie_with_many_and_cut_splitters_and_small_blocks(spark, tmp_path, monkeypatch):
    rows = [(c, k, "u", f"same {k}") for c in range(1000, 1900) for k in range(3)] + conversations()
    want = brute_trie(rows)
    monkeypatch.setattr(tries, "SHARD_BYTES", 2000)
    monkeypatch.setattr(tries, "BLOCK", 50)
    monkeypatch.setattr(tries, "ROWS", 7)
    assert trie(spark, tmp_path / "a", rows) == want
    monkeypatch.setattr(tries, "SKELETON_BYTES", 1)  # splitters of one step
    assert trie(spark, tmp_path / "b", rows) == want


def test_trie_shards_share_copies(spark, monkeypatch):
    monkeypatch.setattr(tries, "SHARD_BYTES", 4000)
    rows = spark.createDataFrame([(c, 0, "u", "one text") for c in range(2000)], "conv_id long, turn long, role string, text string")
    paths = tries.paths(tries.ordered_turns(rows))
    skeleton = tries.Skeleton(tries.choose_splitters(paths))
    parts = tries.walked(paths, skeleton).where("block = -1 and words > 0").collect()
    assert len(parts) > 10 and sum(r.n_convs for r in parts) == 2000 and max(r.n_convs for r in parts) < 600


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda xs: [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]


def test_counts_are_the_library_s():
    want, own = library(), counts.Merges(JSON, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "a" * 50_000, " " * 3000, "".join(rng.choices("abcdefghij", k=5000)), "日本語" * 900, "don't they'll  we've", "x" * 257]
    texts += ["".join(rng.choices("ab c1\n\t  é日!'s\x85\x1c\xa0　 ", k=rng.randint(0, 60))) for _ in range(4000)]
    step = 3
    texts += [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)} \n{chr(c)} !{chr(c)}?" for c in range(0, 0x30000, step) if not 0xD800 <= c <= 0xDFFF]
    assert own.count(texts) == want(texts)


def test_counts_of_pieces_and_small_batches(monkeypatch):
    want, own = library(), counts.Merges(JSON, public_tokenizers.PATTERN)
    monkeypatch.setattr(counts, "BATCH_CHARS", 40)
    monkeypatch.setattr(counts, "MERGE_BYTES", 30)
    monkeypatch.setattr(counts, "CACHE", 5)
    texts = ["one two, three  four\n five " * 30, "<|endoftext|> and" * 20, "no-border" * 40]
    for t in texts:
        assert own.count([t]) == want([t])


def test_all_pairs_of_a_rank_merge_at_once():
    own = counts.Merges(JSON, public_tokenizers.PATTERN)
    rounds = list(own._merge([b"a" * 4096, b"the", b"zq"]))
    assert len(rounds) < 20 and sorted(s for seq, _ in rounds for s in set(seq.tolist())) == [0, 1, 2]


def test_merge_tables_are_checked(tmp_path):
    import json

    told = json.load(open(JSON, encoding="utf-8"))
    told["model"]["merges"] = told["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError, match="later"):
        counts.Merges(str(tmp_path / "t.json"), public_tokenizers.PATTERN)


def test_counts(spark, tmp_path):
    data = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "é"), (4, "word " * 600), (5, "a<|endoftext|>b"), (6, "q" * 100_000)]
    clashing(spark.createDataFrame(data, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(map(tuple, counts.op12_array_merging(spark, str(tmp_path)).collect()), key=repr)
    n = library()([t or "" for _, t in data])
    assert out == sorted(((d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(data, n, strict=True)), key=repr)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert counts.token_counts(none, JSON, public_tokenizers.PATTERN).count() == 0


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for d in (1, 2, 7, 40):
        for kind in range(4):
            y = np.floor(64 * rng.normal(size=(200, d)) * np.exp(-np.arange(d) * 0.5 * kind)).astype(np.int64)
            if kind == 3:  # fewer dimensions, repeated vectors
                y[:, (d + 1) // 2 :] = 0
                y[30:90] = y[0]
            c = y - y.mean(axis=0)
            want = c.T @ c
            top = max(np.trace(want), 1)
            for parts in ([1] * 200, [3, 1, 120, 76], [200]):  # one by one, mixed, triangular
                a, b = whitening.Spectrum(d), whitening.Spectrum(d)
                for k, part in enumerate(np.split(y, np.cumsum(parts)[:-1])):
                    (a, b)[k % 2].add(part)
                a.merge(b)
                assert a.n == 200 and a.sums == y.sum(axis=0).tolist()
                assert np.abs(a.vectors * a.values @ a.vectors.T - want).max() <= 1e-12 * top
                assert np.abs(a.vectors.T @ a.vectors - np.eye(d)).max() <= 1e-12


def test_secular_roots_interlace():
    d, w = np.asarray([0.0, 1e-9, 1.0, 1.0 + 1e-7, 50.0]), np.asarray([1e-12, 3.0, 1e-3, 2.0, 7.0])
    origin, tau = whitening.secular(d, w)
    want = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(w, w)))
    assert np.abs(np.sort(origin + tau) - want).max() < 1e-13 * 63
    assert all(d[k] < origin[k] + tau[k] or tau[k] > 0 for k in range(5)) and (origin + tau)[:-1].max() <= d[-1]


def brute_whitening(vectors, most=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, away = len(x), len(x) * x - x.sum(axis=0)
    c = away / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return n, (away.astype(object) ** 2).sum(axis=1), c @ q[:, :most] / np.sqrt(e[:most]), (e / e.sum())[:most]


def test_whitening(spark, sf, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = clashing(spark.read.parquet(f"{sf}/embeddings.parquet").repartition(7))
    given = {r.vec_id: r.embedding for r in rows.collect()}
    ids = sorted(given)
    n, deviation, white, explained = brute_whitening([given[k] for k in ids])
    out = whitening.whiten(rows, whitening.fit(rows)).toPandas().sort_values(["vec_id", "component"])
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.component.tolist() == [*range(1, 33)] * len(ids) and set(out.n) == {n}
    assert out.deviation.values.reshape(-1, 32)[:, 0].tolist() == deviation.tolist()
    got = out.whitened.values.reshape(-1, 32)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert np.abs(out.explained.values[:32] / explained - 1).max() < 1e-9
    assert set(out.identity_error) < {x for x in out.identity_error if x < 1e-9} | {-1}


def test_whitening_of_odd_vectors(spark):
    nan, inf, rng = float("nan"), float("inf"), np.random.default_rng(1)
    plain = [[float(x) for x in v] for v in rng.normal(size=(40, 3))]
    data = [*enumerate(plain), (None, plain[0]), (7, plain[7]), (100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 1.0]), (103, [0.0, inf, 1.0]), (104, []), (105, [1e300, 0.0, 0.0])]
    data += [(200, [1.0, 2.0]), (201, [1.0, 2.0]), (300, [0.5])]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    out = whitening.whiten(df, whitening.fit(df)).collect()
    three = [r for r in out if r.n == 42]
    assert len(three) == 42 * 3 and {r.vec_id for r in three} == {None, *range(40)}
    n, deviation, _, explained = brute_whitening([*plain, plain[0], plain[7]])
    assert sorted(r.deviation for r in three) == sorted(deviation.tolist() * 3)
    assert all(r.identity_error < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in three)
    rest = [r for r in out if r.n != 42]
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in rest) == [(200, 1, 2, 0), (200, 2, 2, 0), (201, 1, 2, 0), (201, 2, 2, 0), (300, 1, 1, 0)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None for r in rest)
    none = df.where("false")
    assert whitening.whiten(none, whitening.fit(none)).count() == 0


def test_deviations_beyond_machine_integers():
    y = np.asarray([[2**61, 0], [-(2**61), 5]])
    away = whitening._deviations(y, 2, [0, 5])
    assert away.tolist() == [[2**62, -5], [-(2**62), 5]]
    assert whitening._squares(away).to_pylist() == [None, None]
    assert whitening._squares(np.asarray([[3, 4]])).to_pylist() == [25]
