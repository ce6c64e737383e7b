"""Paired comparisons of two arms over cases: t, signed ranks, bootstrap, non-inferiority. Groups are keys, not loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from casewise.functions.stats import normal_sf, t_quantile, t_sf, wilcoxon_exact_sf
from casewise.operators.ordering import mean_ranks
from casewise.operators.rollups import rank_quartile, ranked
from casewise.sources.files import stored

#: Signed-rank p is exact up to this many pairs.
EXACT_PAIRS = 50
LOWER_IS_BETTER = ("false_pos_vol", "false_neg_vol", "num_pred_lesions", "false_missed_lesions", "false_detected_lesions")


def paired_table(df: DataFrame, random_folds: list[int], selected: int, metrics: list[str]) -> DataFrame:
    """case_name, metric, a (mean over the random folds), b (the selected fold), diff; complete pairs only."""
    values = [f for m in metrics for f in (F.avg(F.when(F.col("fold_num").isin(random_folds), F.col(m).cast("double"))).alias(m + "_a"), F.avg(F.when(F.col("fold_num") == selected, F.col(m).cast("double"))).alias(m + "_b"))]
    wide = df.groupBy("case_name").agg(*values)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m + "_a").alias("a"), F.col(m + "_b").alias("b")) for m in metrics]))
    long = wide.select("case_name", pairs.alias("p")).select("case_name", "p.*").where("a is not null and b is not null")
    return long.withColumn("diff", F.col("b") - F.col("a"))


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf(a, b) if pd.notna(a) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_point(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b > 0 else None for a, b in zip(p, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series([normal_sf(a) if pd.notna(a) else None for a in z], dtype="float64")


@F.pandas_udf(DoubleType())
def _rank_tail(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_exact_sf(a, int(b)) if b <= EXACT_PAIRS else None for a, b in zip(w, n, strict=True)], dtype="float64")


def direction(metric: str = "metric") -> Column:
    """1 for metrics where a higher value is better, -1 where a lower one is."""
    return F.when(F.col(metric).isin(*LOWER_IS_BETTER), -1).otherwise(1)


def paired_t(pairs: DataFrame, by: list[str], least: int = 2, sign: Column | None = None) -> DataFrame:
    """n, mean, sd, t of the differences by group, two-sided p, and with `sign` the one-sided p_better; no row for groups below `least`.

    The probabilities are computed on the summary rows alone.
    """
    out = pairs.groupBy(*by).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd")).where(F.col("n") >= least)
    out = out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))))
    df = (F.col("n") - 1).cast("double")
    out = out.withColumn("p", 2 * _t_tail(F.abs("t"), df))
    return out if sign is None else out.withColumn("p_better", _t_tail(sign * F.col("t"), df))


def wilcoxon(pairs: DataFrame, by: list[str], sign: Column | None = None) -> DataFrame:
    """n, w_plus, z of the signed-rank test by group, two-sided p, and with `sign` the one-sided p_better.

    Zeros are dropped, tied ranks averaged; no group is ordered as a whole (see
    mean_ranks); z and p are null where nothing is
    left to vary. p is exact for up to 50 pairs without ties or zeros, else from
    the normal tail.
    """
    sizes = pairs.where("diff is not null").select(*by, "diff", F.round(F.abs("diff"), 9).alias("size"))
    ranks = mean_ranks(sizes, "size", tuple(by), {"above": F.count_if(F.col("diff") > 0)})
    some, t = F.col("size") > 0, F.col("ties").cast("double")
    out = ranks.groupBy(*by).agg(
        F.sum(F.when(some, F.col("ties")).otherwise(0)).alias("n"),
        F.sum(F.when(some, 0).otherwise(F.col("ties"))).alias("zeros"),  # they stand before all others, which move down by them
        F.sum(F.when(some, F.col("above") * F.col("rank")).otherwise(0.0)).alias("_sum"),
        F.sum(F.when(some, F.col("above")).otherwise(0)).alias("_above"),
        F.sum(F.when(some, t * (t * t - 1)).otherwise(0.0)).alias("tie_term"),
    )
    out = out.where("n > 0").withColumn("w_plus", F.col("_sum") - F.col("zeros") * F.col("_above")).drop("_sum", "_above")
    n = F.col("n").cast("double")
    most = n * (n + 1) / 2
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    out = out.withColumn("z", F.when(var > 0, (F.col("w_plus") - most / 2) / F.sqrt(var))).withColumn("tied", F.col("tie_term") > 0)
    exact = (F.col("n") <= EXACT_PAIRS) & ~F.col("tied") & (F.col("zeros") == 0)
    out = out.withColumns({"up": _rank_tail("w_plus", n), "down": _rank_tail(most - F.col("w_plus"), n)})
    two = F.when(exact, F.least(F.lit(1.0), 2 * F.least("up", "down"))).otherwise(2 * _normal_tail(F.abs("z")))
    out = out.withColumn("p", F.when(F.col("z").isNotNull(), two))
    if sign is not None:
        one = F.when(exact, F.when(sign > 0, F.col("up")).otherwise(F.col("down"))).otherwise(_normal_tail(sign * F.col("z")))
        out = out.withColumn("p_better", F.when(F.col("z").isNotNull(), one))
    return out.drop("tie_term", "zeros", "up", "down")


#: Least u of weight 1, 2, ...: the Poisson(1) distribution, cut at six.
POISSON_CUTS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
PRIME = 2_147_483_647
#: Partial sums that one task adds up.
FAN_IN = 64


def draw_weights(h: np.ndarray, draws: int) -> np.ndarray:
    """pairs x draws weights from the pairs' hashes, by squarings modulo a prime: whole numbers that SQL engines can repeat."""
    b = np.arange(1, draws + 1, dtype=np.int64)[None, :]
    h = h.astype(np.int64)[:, None]
    x = (h + b * 1_000_003) % PRIME
    x = (x * x + h) % PRIME
    return np.searchsorted(np.asarray(POISSON_CUTS), ((x * x + b) % PRIME) / PRIME, side="right")


def bootstrap_ci(pairs: DataFrame, by: list[str], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """low, high: 2.5 and 97.5 percentiles of resampled means by group.

    Draw b gives a pair a weight from a hash of (seed, case_name) and b, Poisson(1),
    so no index is joined and each pair meets each draw once. A task keeps, by
    group, one sum of weights and one of weighted differences per draw; only
    these vectors travel and are added up, whatever the number of pairs.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("case_name").cast("string"))), 1, 7), 16, 10).cast("long")
    rows = pairs.where("diff is not null").select(*by, h.alias("h"), F.col("diff").cast("double").alias("diff"))
    keys = ", ".join(f"{k} {t}" for k, t in rows.select(*by).dtypes)

    def add(batches):
        state: dict = {}
        for batch in batches:
            group, names = np.zeros(batch.num_rows, np.int64), {(): 0}
            if by:
                told = list(zip(*[batch.column(k).to_pylist() for k in by], strict=True))
                names = {k: n for n, k in enumerate(dict.fromkeys(told))}
                group = np.asarray([names[k] for k in told], np.int64)
            h, diff = batch.column("h").to_numpy(), batch.column("diff").to_numpy()
            for name, g in names.items():
                at = np.flatnonzero(group == g)
                sums = state.setdefault(name, np.zeros((2, draws)))
                for k in range(0, len(at), 256):
                    w = draw_weights(h[at[k : k + 256]], draws)
                    sums += np.stack([w.sum(axis=0), diff[at[k : k + 256]] @ w])
        if state:
            kinds = {f.name: f.type for f in batch.schema}
            columns = {k: pa.array([name[i] for name in state], kinds[k]) for i, k in enumerate(by)}
            yield pa.RecordBatch.from_pydict(columns | {"part": pa.array([TaskContext.get().partitionId()] * len(state), pa.int64()), "sums": pa.array([s.tobytes() for s in state.values()], pa.binary())})

    def total(t: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(x.as_py()).reshape(2, draws) for x in t.sort_by("part").column("sums"))

    def merge(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).select(by).append_column("part", t.column("part")[:1]).append_column("sums", pa.array([total(t).tobytes()], pa.binary()))

    def ends(t: pa.Table) -> pa.Table:
        w, s = total(t)
        found = np.percentile(s[w > 0] / w[w > 0], [2.5, 97.5]).tolist() if (w > 0).any() else [None, None]
        out = t.slice(0, 1).select(by)
        for name, v in zip(("low", "high"), found, strict=True):
            out = out.append_column(name, pa.array([v], pa.float64()))
        return out

    parts = rows.mapInArrow(add, f"{keys}, part long, sums binary")
    parts = parts.groupBy(*by, F.pmod("part", F.lit(FAN_IN)).alias("_few")).applyInArrow(merge, f"{keys}, part long, sums binary")
    return parts.groupBy(*by).applyInArrow(ends, f"{keys}, low double, high double")


def run_many(pairs: DataFrame, by: list[str], draws: int = 10_000, sign: Column | None = None) -> DataFrame:
    """The t test, the signed-rank test and the bootstrap interval of every group side by side; the data set is one of the keys."""
    t = paired_t(pairs, by, sign=sign).withColumnsRenamed({"p": "t_p", "p_better": "t_p_better"})
    w = wilcoxon(pairs, by, sign).select(*by, "w_plus", "z", F.col("p").alias("w_p"), *([F.col("p_better").alias("w_p_better")] if sign is not None else []))
    return t.join(w, by, "left").join(bootstrap_ci(pairs, by, draws), by, "left")


def noninferiority(pairs: DataFrame, by: list[str], margin: float, alpha: float = 0.05) -> DataFrame:
    """t = (mean - margin) / se by group, the upper confidence limit of the mean, and whether it stays below the margin."""
    out = paired_t(pairs, by).withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")))
    out = out.withColumn("t_margin", F.try_divide(F.col("mean") - margin, F.col("se")))
    ucl = F.col("mean") + _t_point(F.lit(1 - alpha), (F.col("n") - 1).cast("double")) * F.col("se")
    return out.withColumn("ucl", ucl).select(*by, "n", "mean", "se", "t_margin", "ucl", (F.col("ucl") < margin).alias("noninferior"))


def arm_pairs(df: DataFrame, metrics: list[str], offset: int = 2) -> DataFrame:
    """case_name, k, metric, a (fold k), b (fold k + offset), diff of every case in two matched folds; complete pairs only.

    A volume of missed lesions means something only where there are lesions, so
    false_neg_vol pairs are those of cases diseased in both folds, whatever value
    a healthy case has.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = lambda k, v: df.select("case_name", (F.col("fold_num") - k).alias("k"), "diseased", F.explode(pairs).alias("p")).select("case_name", "k", F.col("diseased").alias(f"diseased_{v}"), "p.metric", F.col("p.v").alias(v))
    rows = long(0, "a").join(long(offset, "b"), ["case_name", "k", "metric"]).where("a is not null and b is not null")
    rows = rows.where("metric <> 'false_neg_vol' or (diseased_a and diseased_b)")
    return rows.select("case_name", "k", "metric", "a", "b", (F.col("b") - F.col("a")).alias("diff"))


def arm_tests(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The t test and the signed-rank test of every group side by side, two-sided and in the metric's better direction."""
    ranks = wilcoxon(pairs, by, direction()).select(*by, "w_plus", "z", F.col("p").alias("w_p"), F.col("p_better").alias("w_p_better"))
    return paired_t(pairs, by, sign=direction()).join(ranks, by, "left")


def subgroup_members(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Each pair once per subgroup: overall, its tracer, its tracer with disease state, its disease state over all tracers."""
    state = F.when(F.col("diseased"), "diseased").otherwise("healthy")
    tags = F.array(F.lit("overall"), F.col("tracer"), F.concat_ws("/", "tracer", state), F.concat(state, F.lit(" (all)")))
    return pairs.join(cases.select("case_name", "tracer", "diseased").distinct(), "case_name").withColumn("subgroup", F.explode(tags))


def subgroup_summary(members: DataFrame, by: list[str], least: int = 3, least_p: int = 5) -> DataFrame:
    """n, mean, median, quartiles, win rate and signed-rank p by group, whose keys hold the metric; differences up to 1e-9 are left out, groups below `least` skipped, both p null below `least_p`.

    A win is a difference in the metric's better direction, downwards for volumes
    and counts of errors; p is two-sided, p_better one-sided in that direction.
    """
    d = members.where(F.abs("diff") > 1e-9)
    q = lambda p: F.percentile("diff", F.lit(p))
    won = F.avg((direction() * F.col("diff") > 0).cast("int"))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), q(0.5).alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), won.alias("win_rate")).where(F.col("n") >= least)
    p = wilcoxon(d, by, direction()).where(F.col("n") >= least_p).select(*by, "p", "p_better")
    return out.join(p, by, "left")


def stratified_improvement(members: DataFrame, by: list[str], least: int = 8) -> DataFrame:
    """By group and quartile of the baseline `a`, worst first (q 1): n, median improvement, win percent, signed-rank p, baseline median.

    Improvement is the difference with its sign flipped where a lower value is
    better; groups below `least` pairs are skipped.
    """
    rows = members.withColumn("gain", direction() * F.col("diff")).withColumn("level", F.round(direction() * F.col("a"), 9))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("c")).where(F.col("c") >= least)
    rows = ranked(stored(rows.join(F.broadcast(sizes), by), "strata"), by, "level", "case_name")  # sizes: one row per group
    rows = stored(rows.withColumn("q", rank_quartile(F.col("rank"), F.col("c"))), "strata")
    keys = [*by, "q"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("gain", F.lit(0.5)).alias("median"), (F.avg((F.col("gain") > 0).cast("int")) * 100).alias("win"), F.percentile("a", F.lit(0.5)).alias("baseline"))
    return out.join(wilcoxon(rows.drop("rank").withColumn("diff", F.col("gain")), keys).select(*keys, "p"), keys, "left")


def method_disagreement(df: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """Absolute differences of two methods on the same case, their row mean, mean and difference of dice."""
    pick = lambda m, s: df.where(F.col("method") == m).select("case_id", *[F.col(c).alias(c + s) for c in (*columns, "dice")])
    both = pick(a, "_a").join(pick(b, "_b"), "case_id")
    diffs = {c + "_diff": F.abs(F.col(c + "_a") - F.col(c + "_b")) for c in columns}
    out = both.withColumns(diffs)
    n = sum((F.col(k).isNotNull().cast("int") for k in diffs), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(k, F.lit(0.0)) for k in diffs), F.lit(0.0)), n.cast("double"))
    return out.withColumns({"disagreement": mean, "dice_mean": (F.col("dice_a") + F.col("dice_b")) / 2, "dice_diff": F.abs(F.col("dice_a") - F.col("dice_b"))}).select("case_id", *diffs, "disagreement", "dice_mean", "dice_diff")


def similar_and_dissimilar(disagreement: DataFrame, least_dice: float, k: int) -> DataFrame:
    """kind, case_id, disagreement: among cases with a mean dice above `least_dice` the k that the methods agree on most (similar) and least (dissimilar); ties by id."""
    good = disagreement.where((F.col("dice_mean") > least_dice) & F.col("disagreement").isNotNull()).select("case_id", "disagreement")
    end = lambda kind, order: good.orderBy(order, "case_id").limit(k).select(F.lit(kind).alias("kind"), "case_id", "disagreement")
    return end("similar", F.asc("disagreement")).unionByName(end("dissimilar", F.desc("disagreement")))
