"""Hand-built cases: masks, names, tails, kernel PCA and greedy selection against direct computation."""

import hashlib
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.functions import stats
from casewise.functions.names import case_key, tracer_of
from casewise.operators import paired, selection, voxels
from casewise.operators.ordering import quantile_group
from casewise.sources import files


def vox(spark, cells):
    return spark.createDataFrame([(1, *c) for c in cells], "case_id long, x int, y int, z int, gt int, pred int")


@pytest.mark.parametrize(("b", "c6", "c18", "c26"), [((2, 1, 1), 1, 1, 1), ((2, 2, 1), 2, 1, 1), ((2, 2, 2), 2, 2, 1)])
def test_connectivity(spark, b, c6, c18, c26):
    df = vox(spark, [(1, 1, 1, 1, 0), (*b, 1, 0)])
    for c, want in ((6, c6), (18, c18), (26, c26)):
        assert voxels.connected_components(df, "gt", c).agg(F.max("comp")).first()[0] == want


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(0)
    cells = [c for c in itertools.product(range(7), repeat=3) if rng.random() < 0.25]
    got = {(r.x, r.y, r.z): r.comp for r in voxels.connected_components(vox(spark, [(*c, 1, 0) for c in cells]), "gt").collect()}
    left, want, k = set(cells), {}, 0
    for c in sorted(cells, key=lambda c: c[::-1]):
        if c not in left:
            continue
        k, stack = k + 1, [c]
        while stack:
            p = stack.pop()
            if p in left:
                left.remove(p)
                want[p] = k
                stack += [tuple(np.add(p, o).tolist()) for o in voxels.offsets(18)]
    assert got == want


@pytest.mark.parametrize(("tp", "fp", "fn", "want"), [(0, 0, 0, (None, 0.0, 1.0)), (0, 1, 0, (0.0, 0.0, 0.0)), (2, 0, 0, (1.0, 1.0, 1.0)), (1, 1, 1, (0.5, 0.5, 0.5))])
def test_dice_conventions(spark, tp, fp, fn, want):
    t = [F.lit(v) for v in (tp, fp, fn)]
    assert tuple(spark.range(1).select(*[voxels.dice(*t, e).alias(str(k)) for k, e in enumerate((None, 0.0, 1.0))]).first()) == want


def test_names(spark):
    df = spark.createDataFrame([("fdg_1",), ("PSMA_2",), ("target_9",), ("other",)], "n string")
    got = [tuple(r) for r in df.select(tracer_of(F.col("n")), tracer_of(F.col("n"), "prefix"), tracer_of(F.col("n"), "default_psma")).collect()]
    assert got == [("FDG", "FDG", "FDG"), ("PSMA", "PSMA", "PSMA"), ("Unknown", None, "PSMA"), ("Unknown", None, "PSMA")]
    assert spark.range(1).select(case_key(F.lit("/a/b/fdg_1_0001.nii.gz"))).first()[0] == "fdg_1"


def test_tails():
    assert stats.t_sf(2.228, 10) == pytest.approx(0.025, abs=1e-4)
    assert stats.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert stats.t_quantile(0.95, 5) == pytest.approx(2.015, abs=1e-3)
    assert stats.wilcoxon_exact_sf(15, 5) == pytest.approx(1 / 32)


def test_wilcoxon_by_hand(spark):
    df = spark.createDataFrame([("m", str(i), d) for i, d in enumerate([1.0, -2.0, 2.0, 0.0, 3.0])], "metric string, case_name string, diff double")
    r = paired.wilcoxon(df, ["metric"]).first()
    assert (r.n, r.w_plus, r.tied) == (4, 1 + 2.5 + 4, True)
    same = spark.createDataFrame([("m", "a", 0.0)], "metric string, case_name string, diff double")
    assert paired.wilcoxon(same, ["metric"]).count() == 0


def cases(spark, n=40, d=6):
    x = np.random.default_rng(1).normal(size=(n, d))
    return x, spark.createDataFrame([(i, "FDG", v.tolist()) for i, v in enumerate(x)], "case_id long, tracer string, embedding array<double>")


def test_kernel_pca(spark):
    x, df = cases(spark)
    got = np.array([r.pc for r in selection.cosine_kernel_pca(df, df).orderBy("case_id").collect()])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    k = u @ u.T
    n = len(k)
    c = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(c @ k @ c)
    want = v[:, ::-1][:, :2] * np.sqrt(w[::-1][:2])
    for j in range(2):
        assert np.allclose(np.abs(got[:, j]), np.abs(want[:, j]), atol=1e-9)


def test_dpp_against_determinants(spark):
    x, df = cases(spark, 20, 6)
    got = [r.case_id for r in selection.dpp_greedy(df, 4).orderBy("pick").collect()]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    chosen = []
    for _ in range(4):
        best = max((i for i in range(20) if i not in chosen), key=lambda i: (round(float(u[i] @ u[i] - (u[i] @ u[chosen].T @ np.linalg.inv(u[chosen] @ u[chosen].T + 1e-6 * np.eye(len(chosen))) @ u[chosen] @ u[i] if chosen else 0)), 9), -i))
        chosen.append(best)
    assert got == chosen


def test_quantile_group_sizes(spark):
    df = spark.range(11).select(F.col("id").alias("case_id"), (F.col("id") % 3).cast("double").alias("score"))
    n = sorted((r.q, r["count"]) for r in quantile_group(df, "score", ["case_id"], 4, "q").groupBy("q").count().collect())
    assert n == [(1, 3), (2, 3), (3, 3), (4, 2)]


def test_overlap_threshold_is_strict():
    assert not 1 / 100 * 100 > voxels.OVERLAP_PERCENT
    assert math.isclose(voxels.HIGH_RISK_MM3, 4180)


def test_bootstrap_takes_ten_thousand_draws(spark, sf):
    from casewise.plans import metrics

    data = [(f"case{i}", m, float(i * i % 7) + k) for i in range(5) for k, m in enumerate(("dice", "vol"))]
    got = {r.metric: (r.low, r.high) for r in paired.bootstrap_ci(spark.createDataFrame(data, "case_name string, metric string, diff double"), ["metric"]).collect()}
    h = np.array([int(hashlib.md5(f"0:case{i}".encode()).hexdigest()[:7], 16) for i in range(5)], object)
    p, w = 2**31 - 1, []
    for draw in range(1, 10_001):
        x = [(v + draw * 1_000_003) % p for v in h]
        u = [(((y * y + v) % p) ** 2 + draw) % p / p for y, v in zip(x, h, strict=True)]
        w.append(np.searchsorted(np.round(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(6)]), 8), u, side="right"))
    w = np.array(w)
    for k, m in enumerate(("dice", "vol")):
        diff = np.array([float(i * i % 7) + k for i in range(5)])
        means = (w @ diff)[w.sum(axis=1) > 0] / w.sum(axis=1)[w.sum(axis=1) > 0]
        assert got[m] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-9)
    want = metrics._r(paired.bootstrap_ci(metrics._pairs(spark, sf), ["metric"], 10_000))
    assert sorted(map(tuple, metrics.t4(spark, sf).collect())) == sorted(map(tuple, want.collect()))


def test_kmeans_takes_the_best_of_ten_starts(spark, sf, monkeypatch):
    from casewise.plans import selection as plans

    x = [[0.0, 0.0], [0.0, 1.0], [4.0, 0.0], [4.0, 1.0], [9.0, 5.0], [9.0, 6.0], [1.0, 9.0]]
    got = {r.case_id: r.cluster for r in selection.kmeans_clusters(spark.createDataFrame(list(enumerate(x)), "case_id long, embedding array<double>"), 3).collect()}

    def cost(label):
        return sum(((p - p.mean(axis=0)) ** 2).sum() for k in set(label) for p in [np.array([v for v, c in zip(x, label, strict=True) if c == k])])

    assert cost([got[i] for i in range(7)]) == pytest.approx(min(cost(c) for c in itertools.product(range(3), repeat=7)))
    seeds, fitted = [], selection.KMeans
    monkeypatch.setattr(selection, "KMeans", lambda **kw: seeds.append(kw["seed"]) or fitted(**kw))
    plans.e17(spark, sf).count()
    assert len(set(seeds)) == 10


def test_dpp_splits_have_the_fresh_form_too(spark, sf):
    from casewise.plans import selection as plans

    picks = selection.dpp_greedy(plans.fixture(spark, sf, "fx_cases"), 6).collect()
    got = {(r.budget, r.case_id) for r in plans.x3(spark, sf).where("form = 'fresh'").collect()}
    assert got == {(k, r.case_id) for k in (2, 4, 6) for r in picks if r.pick <= k}


def test_signed_rank_p_against_enumeration(spark):
    d = [0.3, -0.1, 0.7, 1.1, -0.4, 0.9, 0.2]
    order = np.argsort(np.argsort(np.abs(d))) + 1
    w = sum(r for r, v in zip(order, d, strict=True) if v > 0)
    sums = [sum(r for r, s in zip(order, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    up, down = np.mean([s >= w for s in sums]), np.mean([s <= w for s in sums])
    df = spark.createDataFrame([("dice", str(i), v) for i, v in enumerate(d)] + [("false_pos_vol", str(i), v) for i, v in enumerate(d)], "metric string, case_name string, diff double")
    got = {r.metric: r for r in paired.wilcoxon(df, ["metric"], paired.direction()).collect()}
    assert got["dice"].p == pytest.approx(min(1, 2 * min(up, down)))
    assert (got["dice"].p_better, got["false_pos_vol"].p_better) == (pytest.approx(up), pytest.approx(down))


def test_paired_tests_without_spread(spark):
    df = spark.createDataFrame([("dice", str(i), 0.5) for i in range(3)], "metric string, case_name string, diff double")
    r = paired.paired_t(df, ["metric"], sign=paired.direction()).first()
    assert (r.t, r.p, r.p_better) == (None, None, None)
    assert paired.paired_t(df.limit(1), ["metric"]).count() == 0


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.3, 1.0, 120)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(d)], "metric string, case_name long, diff double")
    want = np.percentile(d[rng.integers(0, len(d), (20_000, len(d)))].mean(axis=1), [2.5, 97.5])
    for parts in (1, 7):  # one state and merged ones
        r = paired.bootstrap_ci(df.repartition(parts), ["metric"], 4000).first()
        assert np.abs(np.array([r.low, r.high]) - want).max() < 0.03


def test_noninferiority_verdict(spark):
    df = spark.createDataFrame([("m", str(i), v) for i, v in enumerate([0.01, -0.02, 0.0, 0.02, -0.01, 0.0])], "metric string, case_name string, diff double")
    wide, tight = (paired.noninferiority(df, ["metric"], m).first() for m in (0.05, 0.001))
    assert wide.noninferior and not tight.noninferior
    assert wide.ucl == pytest.approx(2.0150484 * wide.se, abs=1e-6)


def test_small_and_large_labelled_sides_agree(spark, monkeypatch):
    from casewise.operators import cells

    x, df = cases(spark)
    pool, seed = df.where("case_id >= 9"), df.where("case_id < 9")
    other = pool.withColumn("tracer", F.when(F.col("case_id") == 20, "none").otherwise(F.col("tracer")))
    run = lambda: (sorted(map(tuple, selection.min_distance_to_labelled(other, seed).collect())), sorted(map(tuple, selection.extremes(pool, seed).collect())))
    near, ends = run()
    monkeypatch.setattr(selection, "SMALL_BYTES", -1)
    monkeypatch.setattr(cells, "BLOCK", 3)
    monkeypatch.setattr(cells, "CELL", 5)
    far_near, far_ends = run()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (1 - u[9:] @ u[:9].T).min(axis=1)
    want[11] = 0
    for got in (near, far_near):
        assert [r[0] for r in got] == list(range(9, 40))
        assert [r[2] for r in got] == pytest.approx(want.tolist())
    assert [r[:4] for r in ends] == [r[:4] for r in far_ends] and [r[4] for r in ends] == pytest.approx([r[4] for r in far_ends])


def test_summaries_and_diagnoses_from_files(spark, tmp_path):
    import json

    from casewise.sources import files

    folder = tmp_path / "Dataset007_x" / "fold_2" / "validation"
    folder.mkdir(parents=True)
    one = {"foreground_mean": {"Dice": 0.5}, "metric_per_case": [{"prediction_file": "p/fdg_1.nii.gz", "metrics": {"1": {"TP": 3, "FP": 1, "FN": 0, "Dice": float("nan")}}}]}
    (folder / "summary.json").write_text(json.dumps(one, indent=1))
    got = files.read_summaries(spark, f"file://{tmp_path}/*/fold_*/*/summary.json").collect()
    assert [tuple(r) for r in got] == [(7, "validation", 2, "fdg_1", 3, 1, 0, None, 0.5)]
    (tmp_path / "meta.csv").write_text("file_location,diagnosis\n./d/PETCT_ab/s1/x,LYMPHOMA\n./d/PETCT_ab/s1/y,LYMPHOMA\n")
    assert [tuple(r) for r in files.read_diagnosis(spark, f"file://{tmp_path}/meta.csv").collect()] == [("fdg_ab_s1", "LYMPHOMA")]


def test_stream_goes_on_after_an_interruption(spark, tmp_path):
    from casewise.streaming import incremental

    schema = "case_id long, x int, y int, z int, gt int, pred int"
    row = lambda i: spark.createDataFrame([(i, 0, 0, 1, 1, 1), (i, 1, 0, 1, 1, i % 2)], schema).coalesce(1)
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    go = lambda: incremental.stream_case_metrics(spark, src, out, mark, schema, 1.0, 100, 1)
    row(1).write.parquet(src)
    go()
    row(2).write.mode("append").parquet(src)
    go()
    go()
    got = spark.read.parquet(out).select("case_id", "dice", "batch").orderBy("case_id").collect()
    assert [(r.case_id, round(r.dice, 6)) for r in got] == [(1, 1.0), (2, round(2 / 3, 6))]
    assert len({r.batch for r in got}) == 2


def test_a_case_in_several_files_waits_for_all_of_them(spark, tmp_path):
    from casewise.streaming import incremental

    schema = "case_id string, part int, parts int, x int, y int, z int, gt int, pred int"
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))

    def arrive(*rows, wait=10**9):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.stream_split_cases(spark, src, out, mark, "string", 1.0, 100, wait)

    def got():
        return sorted((r.case_id, r.status, round(r.dice, 6), r.gt_lesions) for r in spark.read.parquet(out).collect())

    arrive(("a", 0, 3, 0, 0, 1, 1, 1), ("b", 0, 1, 5, 5, 1, 1, 0), ("c", 0, 2, 0, 0, 1, 1, 1), wait=1)
    assert got() == [("b", "ok", 0.0, 1)]
    arrive(("a", 2, 3, 1, 0, 1, 1, 0), ("a", 0, 3, 0, 0, 1, 1, 1))  # a part that comes again; c has waited too long
    assert ("c", "incomplete", 1.0, 1) in got() and not any(r[0] == "a" and r[1] == "ok" for r in got())
    arrive(("d", 0, 2, None, None, None, None, None), ("d", 1, 2, None, None, None, None, None), ("e", 0, 3, 9, 9, 9, 1, 1))
    arrive(("e", 1, 3, 9, 8, 9, 1, 1), ("e", 1, 3, 9, 8, 9, 1, 1))
    arrive(("e", 2, 3, None, None, None, None, None))
    assert [r for r in got() if r[0] in "de"] == [("d", "ok", 0.0, 0), ("e", "ok", 1.0, 1)]


def test_align_axes_and_shapes_that_disagree(spark):
    v = spark.createDataFrame([(1, 4, 5, 6), (2, 4, 5, 6), (3, 4, 5, 6), (4, 4, 5, 6)], "case_id long, x int, y int, z int")
    shapes = spark.createDataFrame([(1, [7, 8, 9], [7, 8, 9]), (2, [7, 8, 9], [9, 8, 7]), (3, [7, 8, 9], [9, 7, 8]), (4, [7, 8, 9], [1, 1, 1])], "case_id long, shape array<int>, target array<int>")
    got = {r.case_id: (r.x, r.y, r.z) for r in voxels.align_axes(v, shapes).collect()}
    assert got == {1: (4, 5, 6), 2: (6, 5, 4), 3: (6, 4, 5), 4: (None, None, None)}


def test_numbered_by_group(spark):
    from casewise.operators.ordering import furthest_first, numbered

    rows = [(g, i, [0.5, None, 0.25, 0.5, 2.0, 0.0][i % 6]) for g in ("a", "b") for i in range(6 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i long, d double")
    for name, f, key in (("up", lambda: numbered(df, "d", ["i"], by=("g",), buckets=3), lambda r: (r[2] is None, r[2] or 0, r[1])), ("down", lambda: furthest_first(df, "d", ["i"], by=("g",)), lambda r: (r[2] is None, -(r[2] or 0), r[1]))):
        want = {(g, r[1]): k + 1 for g in ("a", "b") for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=key))}
        assert {(r.g, r.i): r.rn for r in f().collect()} == want, name


def test_dpp_with_quality_against_weighted_kernel(spark):
    x, df = cases(spark, 20, 6)
    q = 1.0 + np.arange(20) % 5
    got = [r.case_id for r in selection.dpp_greedy(df.withColumn("q", 1 + F.col("case_id") % 5), 4, "q").orderBy("pick").collect()]
    u = x / np.linalg.norm(x, axis=1)[:, None] * (q / q.max())[:, None]
    kernel, chosen = u @ u.T, []
    for _ in range(4):
        rest = kernel[np.ix_(chosen, chosen)] + 1e-6 * np.eye(len(chosen))
        gain = np.array([kernel[i, i] - (kernel[i, chosen] @ np.linalg.solve(rest, kernel[chosen, i]) if chosen else 0) for i in range(20)])
        gain[chosen] = -np.inf
        chosen.append(int(np.round(gain, 9).argmax()))
    assert got == chosen


def test_mean_ranks_and_ties_over_buckets(spark):
    from casewise.operators.ordering import mean_ranks

    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in ("a", "b") for v in np.round(rng.normal(size=400), 1)] + [("c", 2.0)] * 50
    out = mean_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ("g",), {"n": F.count("*")}, buckets=9).collect()
    for g in "abc":
        values = np.sort([v for h, v in rows if h == g])
        want = {v: (np.flatnonzero(values == v) + 1).mean() for v in values}
        assert {r.v: r["rank"] for r in out if r.g == g} == want and sum(r.n for r in out if r.g == g) == len(values)
    plan = paired.wilcoxon(spark.createDataFrame([("m", 1.0)], "metric string, diff double"), ["metric"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rank(size" not in plan


def test_overlaps_of_a_thousand_splits(spark):
    from casewise.operators import splits

    df = spark.range(1000).selectExpr("id as split_id", "explode(sequence(0, 19)) as k").selectExpr("split_id", "'train' as role", "concat('c', (split_id * 7 + k * k) % 300) as case_id")
    has = {}
    for r in df.collect():
        has.setdefault(r.split_id, set()).add(r.case_id)
    out = splits.overlap_matrix(df).where("i in (0, 17, 999)").collect()
    assert len(out) == 3000 and all(r.n == len(has[r.i] & has[r.j]) for r in out)


@pytest.mark.parametrize("pool_bytes", [1 << 20, 6 * 8 * 5])
def test_lazy_picks_are_the_greedy_ones(spark, monkeypatch, pool_bytes):
    monkeypatch.setattr(selection, "POOL_BYTES", pool_bytes)
    x, df = cases(spark, n=60)
    df = df.withColumns({"case_id": F.format_string("c%02d", F.col("case_id")), "tracer": F.lit("FDG")})
    df = df.union(df.withColumns({"case_id": F.concat("case_id", F.lit("b")), "tracer": F.lit("PSMA")})).union(df.where("case_id = 'c05'").withColumn("case_id", F.lit("c05x")))
    sc, k = spark.sparkContext, 5
    sc.setJobGroup(f"lazy {pool_bytes}", "")
    got = selection.dpp_greedy(df, k).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"lazy {pool_bytes}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m, want = np.eye(6) / 1e-6, []
    for _ in range(k):
        gains = np.round(1e-6 * np.einsum("ij,jk,ik->i", u, m, u), 12)
        best = int(gains.argmax())
        y = m @ u[best]
        m = m - np.outer(y, y) / (1 + u[best] @ y)
        want.append((f"c{best:02d}", gains[best]))
    for tracer, end in (("FDG", ""), ("PSMA", "b")):
        own = sorted((r for r in got if r.tracer == tracer), key=lambda r: r.pick)
        assert [(r.pick, r.case_id) for r in own] == [(n + 1, c + end) for n, (c, _) in enumerate(want)]
        assert [r.gain for r in own] == pytest.approx([g for _, g in want], abs=1e-9)
    few = selection.dpp_greedy(df.where("case_id in ('c01', 'c02')"), 9).collect()
    assert len(few) == 2 and selection.dpp_greedy(df.where("false"), 3).count() == 0
    if pool_bytes > 1000:
        many = f"many {pool_bytes}"
        sc.setJobGroup(many, "")
        assert selection.dpp_greedy(df.drop("embedding").withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.hash("case_id", i).cast("double"))), 60).count() == 120
        assert len(sc.statusTracker().getJobIdsForGroup(many)) < 60 / 5
        sc.setLocalProperty("spark.jobGroup.id", None)


def arms(spark):
    """Twelve cases in folds 0 and 2; healthy ones have zeros, not nulls, for missed volume; fold 2 has less error."""
    rows = [(c, f, "FDG" if c % 2 else "PSMA", c % 3 > 0 and not (c == 4 and f == 2), 0.1 * c + 0.01 * f * c, 20.0 + c - f * (1 + c / 9), (5.0 + c - f * (2 + c / 7)) if c % 3 else 0.0) for c in range(12) for f in (0, 2)]
    return spark.createDataFrame(rows, "case_name long, fold_num int, tracer string, diseased boolean, dice double, false_pos_vol double, false_neg_vol double")


def test_missed_volume_is_compared_on_cases_diseased_in_both(spark):
    pairs = paired.arm_pairs(arms(spark), ["dice", "false_pos_vol", "false_neg_vol"])
    who = lambda m: sorted(r.case_name for r in pairs.where(F.col("metric") == m).collect())
    assert who("dice") == who("false_pos_vol") == list(range(12))
    assert who("false_neg_vol") == [1, 2, 5, 7, 8, 10, 11]
    assert {r.metric: r.n for r in paired.arm_tests(pairs, ["k", "metric"]).collect()} == {"dice": 12, "false_pos_vol": 12, "false_neg_vol": 7}


def test_wins_go_by_the_metric_s_direction(spark):
    df = arms(spark)
    pairs = paired.arm_pairs(df, ["dice", "false_pos_vol"])
    members = paired.subgroup_members(pairs, df.where("fold_num = 0"))
    assert {r.subgroup for r in members.select("subgroup").distinct().collect()} == {"overall", "FDG", "PSMA", "FDG/diseased", "FDG/healthy", "PSMA/diseased", "PSMA/healthy", "diseased (all)", "healthy (all)"}
    out = {(r.metric, r.subgroup): r for r in paired.subgroup_summary(members, ["metric", "subgroup"]).collect()}
    volume, dice = out["false_pos_vol", "overall"], out["dice", "overall"]
    assert volume.win_rate == 1.0 and volume.mean < 0 and dice.win_rate == 1.0 and dice.mean > 0
    assert volume.p_better == pytest.approx(2**-12) and dice.p_better == pytest.approx(2**-11) and volume.p == pytest.approx(2 * volume.p_better)
    assert ("false_pos_vol", "FDG/healthy") not in out
    assert out["false_pos_vol", "healthy (all)"].n == 4 and out["false_pos_vol", "healthy (all)"].p_better is None


def dense_linear(a, target):
    """Linear interpolation of a dense array, one axis after another, by numpy.interp on coinciding corners."""
    for axis, m in enumerate(target):
        n = a.shape[axis]
        at = np.arange(m) * ((n - 1) / (m - 1)) if m > 1 else np.zeros(1)
        a = np.apply_along_axis(lambda line: np.interp(at, np.arange(n), line), axis, a)
    return a


def dense_nearest(a, target):
    for axis, m in enumerate(target):
        n = a.shape[axis]
        a = np.take(a, [(2 * i * (n - 1) + max(m - 1, 1)) // (2 * max(m - 1, 1)) for i in range(m)], axis)
    return a


GRIDS = [((4, 5, 3), (7, 5, 2)), ((4, 5, 3), (1, 11, 3)), ((1, 6, 2), (5, 3, 9)), ((3, 1, 1), (2, 1, 4)), ((9, 2, 7), (4, 2, 13))]


@pytest.mark.parametrize("order", [0, 1])
def test_resampled_grids_against_numpy(spark, order):
    rng = np.random.default_rng(3)
    volumes = {f"case_{i}": rng.integers(0, 6, n) for i, (n, _) in enumerate(GRIDS)}
    rows = [(c, x, y, z, int(v), float(v) / 4, "extra") for c, a in volumes.items() for (x, y, z), v in np.ndenumerate(a) if v]
    rows += [("case_0", 9, 0, 0, 5, 5.0, "outside"), ("case_0", -1, 0, 0, 5, 5.0, "outside"), ("no_shape", 0, 0, 0, 5, 5.0, "")]
    cells = spark.createDataFrame(rows, "case_id string, x int, y int, z int, v long, f double, i string")
    shapes = spark.createDataFrame([(f"case_{i}", list(n), list(m)) for i, (n, m) in enumerate(GRIDS)] * 2 + [("no_voxels", [2, 2, 2], [3, 3, 3]), ("no_shape", None, [1, 1, 1])], "case_id string, source array<int>, target array<int>")
    got = {(r.case_id, r.x, r.y, r.z): (r.v, r.f) for r in voxels.resample(cells, shapes, ("v", "f"), order).collect()}
    way = dense_linear if order else dense_nearest
    want = {}
    for i, (_, m) in enumerate(GRIDS):
        a = way(volumes[f"case_{i}"].astype(float), m)
        want |= {(f"case_{i}", *p): v for p, v in np.ndenumerate(a) if v > 1e-12}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k]) < 1e-9 and abs(got[k][1] - want[k] / 4) < 1e-9 for k in want)


def test_resampling_of_nothing_and_nulls(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, None), ("a", 1, 0, 0, 4)], "case_id string, x int, y int, z int, v int")
    shapes = spark.createDataFrame([("a", [2, 1, 1], [3, 1, 1])], "case_id string, source array<int>, target array<int>")
    assert sorted((r.x, r.v) for r in voxels.resample(cells, shapes, ("v",)).collect()) == [(0, 0.0), (1, 2.0), (2, 4.0)]
    assert sorted((r.x, r.v) for r in voxels.resample(cells, shapes, ("v",), 0).collect()) == [(0, 0), (1, 4), (2, 4)]
    assert voxels.resample(cells.limit(0), shapes, ("v",)).count() == 0
    with pytest.raises(ValueError):
        voxels.resample(cells, shapes, ("v",), 3)


def test_split_parts_keep_places_and_blocks(spark, tmp_path):
    rows = [(s, role, p, f"c{s}_{p}" if p != 7 else None) for s in range(3) for role, n in (("train", 25), ("val", 3)) for p in range(n) if p != 12]
    files.write_split_parts(spark.createDataFrame(rows, "split_id int, role string, pos int, case string"), str(tmp_path / "parts"), block=10)
    back = files.read_split_parts(spark, str(tmp_path / "parts"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    lines = spark.read.schema("cases array<string>").json(str(tmp_path / "parts")).selectExpr("size(cases) n").collect()
    assert max(r.n for r in lines) == 10 and len(lines) == 3 * 4


def test_stored_tables_can_be_cleared(spark, tmp_path):
    files.clear_stored(spark)
    kept = str(tmp_path / "kept")
    rows = files.stored(spark.range(5).withColumnRenamed("id", "n"))
    rows.write.parquet(kept)
    path = files.WRITTEN[-1]
    assert files.clear_stored(spark) == 1 and files.clear_stored(spark) == 0
    assert not os.path.exists(path.removeprefix("file://")) and spark.read.parquet(kept).count() == 5
