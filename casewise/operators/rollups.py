"""Roll-ups of per-case metrics by fold, tracer, diagnosis, region and arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.operators.ordering import numbered

#: Training cases per fold, by tracer; fixed values.
TRAIN_SIZES = {
    "FDG": [6, 33, 66, 72, 99, 132, 199, 265, 332, 398, 464, 664],
    "PSMA": [3, 18, 37, 40, 55, 75, 113, 151, 189, 227, 265, 379],
}


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN stands for missing in the inputs; null from here on."""
    return df.withColumns({n: F.nanvl(n, F.lit(None)) for n, t in df.dtypes if t in ("double", "float")})


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean_ci(name: str, z: float = 1.96) -> list[Column]:
    """n, mean, sample deviation, and mean -+ z standard errors (null for one value)."""
    n, m, s = F.count(name), F.avg(name), F.stddev_samp(name)
    half = z * s / F.sqrt(n.cast("double"))
    return [n.alias(f"{name}_n"), m.alias(f"{name}_mean"), s.alias(f"{name}_std"), (m - half).alias(f"{name}_low"), (m + half).alias(f"{name}_high")]


def image_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """mean_ci of each column by fold with tracer All, and by fold and tracer: grouping sets, one shuffle."""
    out = df.groupingSets([["fold"], ["fold", "tracer"]], "fold", "tracer").agg(*[c for n in names for c in mean_ci(n)])
    return out.withColumn("tracer", F.coalesce("tracer", F.lit("All")))


#: The columns whose mean and deviation a detection summary adds.
DETECTION_COLUMNS = ("dice", "false_pos_vol", "false_neg_vol", "num_gt_lesions", "num_pred_lesions", "false_missed_lesions", "false_detected_lesions", "case_sensitivity")


def detection_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Images, lesions, hits and misses, sensitivity and PPV of lesion counts; mean and deviation of eight columns."""
    gt, miss, pred, false = (F.sum(c) for c in ("num_gt_lesions", "false_missed_lesions", "num_pred_lesions", "false_detected_lesions"))
    spread = [f(c).alias(f"{c}_{k}") for c in DETECTION_COLUMNS for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return derived_lesion_columns(df).groupBy(*by).agg(F.countDistinct("case_name").alias("images"), gt.alias("lesions"), (gt - miss).alias("tp"), false.alias("fp"), miss.alias("fn"), ratio(gt - miss, gt).alias("sensitivity"), ratio(pred - false, pred).alias("ppv"), *spread)


def segment_summary(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def high_risk_summary(flags: DataFrame, by: list[str]) -> DataFrame:
    """Counts of high-risk regions and their sensitivity (0 where there is none) per image, then mean, deviation and interval by group."""
    hit = F.count_if(F.col("hr_ground") & F.col("hr_pred"))
    per = flags.groupBy("case_id", *by).agg(F.count_if(F.col("hr_ground")).alias("hr_gt"), F.count_if(F.col("hr_pred")).alias("hr_pr"), F.coalesce(ratio(hit, F.count_if(F.col("hr_ground"))), F.lit(0.0)).alias("hr_sens"))
    return per.groupBy(*by).agg(*mean_ci("hr_gt"), *mean_ci("hr_pr"), *mean_ci("hr_sens"))


def liver_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("int")) * 100
    hit = F.count_if(F.col("hr_ground") & F.col("hr_pred"))
    return rows.groupBy(*by).agg(share("hr_ground").alias("hr_gt_percent"), share("hr_pred").alias("hr_pred_percent"), ratio(hit, F.count_if(F.col("hr_ground"))).alias("sensitivity"), F.avg("gt_mm3").alias("gt_mean"), F.stddev_samp("gt_mm3").alias("gt_std"))


def patient_level(df: DataFrame, by: list[str]) -> DataFrame:
    sick, seen = F.col("diseased"), F.col("num_pred_lesions") > 0
    only = lambda c: F.when(sick, F.col(c))
    return df.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(sick).alias("n_diseased"), F.avg(only("dice")).alias("dice"), F.avg("false_pos_vol").alias("fp_mean"), F.sum("false_pos_vol").alias("fp_total"), F.avg(only("false_neg_vol")).alias("fn_mean"), F.sum(only("false_neg_vol")).alias("fn_total"), ratio(F.count_if(sick & seen), F.count_if(sick)).alias("sensitivity"), ratio(F.count_if(~sick & ~seen), F.count_if(~sick)).alias("specificity"))


def derived_lesion_columns(df: DataFrame) -> DataFrame:
    """detected, sensitivity of the case (null without lesions), detection_rate = 1 - missed / lesions."""
    gt, miss = F.col("num_gt_lesions"), F.col("false_missed_lesions")
    return df.withColumns({"detected": gt - miss, "case_sensitivity": ratio(gt - miss, gt), "detection_rate": 1 - ratio(miss, gt)})


def lesion_level(df: DataFrame, by: list[str]) -> DataFrame:
    """Lesion figures of the diseased cases; healthy ones count nowhere in them."""
    d = derived_lesion_columns(df.where("diseased"))
    gt, hit, pred, false = (F.sum(c) for c in ("num_gt_lesions", "detected", "num_pred_lesions", "false_detected_lesions"))
    return d.groupBy(*by).agg(gt.alias("gt"), hit.alias("detected"), ratio(hit, gt).alias("micro"), F.avg("case_sensitivity").alias("macro"), ratio(false, F.count("*")).alias("fp_per_case"), ratio(false, pred).alias("fdr"))


def region_tags(description: Column, is_bone: Column, high_risk: Column) -> Column:
    """The groups a region row belongs to: liver, lung, bone, hr_bone."""
    return F.array_compact(F.array(F.when(description.contains("liver"), F.lit("liver")), F.when(description.contains("lung"), F.lit("lung")), F.when(is_bone, F.lit("bone")), F.when(is_bone & high_risk, F.lit("hr_bone"))))


def overlap_gate(rows: DataFrame, threshold_cm3: float) -> DataFrame:
    keep = lambda c: F.coalesce(F.col(c) / 1000, F.lit(0.0)) > threshold_cm3
    return rows.where(keep("gt_mm3") | keep("pred_mm3"))


def organ_level(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("organ", F.explode("tags")).groupBy(*by, "organ").agg(F.count("*").alias("n"), F.avg("dice").alias("dice"), F.avg("fp_vol").alias("fp_mean"), F.sum("fp_vol").alias("fp_total"), F.avg("fn_vol").alias("fn_mean"), F.sum("fn_vol").alias("fn_total"), F.sum("gt_lesions").alias("lesions"))


def arm_summary(df: DataFrame, organs: DataFrame, names: list[str]) -> DataFrame:
    """One row per fold: headline patient and lesion figures, the case-weighted mean dice of the tracers, and each organ's dice.

    `organs` has fold, organ, n, dice (of organ_level by fold and further
    keys); an organ's dice is their mean weighted by the number of regions, null
    where a fold has none.
    """
    p = patient_level(df, ["fold"]).select("fold", "dice", "fp_mean", "fn_mean", "sensitivity", "specificity")
    weighted = patient_level(df, ["fold", "tracer"]).groupBy("fold").agg((F.sum(F.col("dice") * F.col("n_diseased")) / F.sum("n_diseased")).alias("weighted_dice"))
    n = F.when(F.col("dice").isNotNull(), F.col("n"))
    wide = organs.groupBy("fold").agg(*[ratio(F.sum(F.when(F.col("organ") == k, F.col("dice") * n)), F.sum(F.when(F.col("organ") == k, n))).alias(f"{k}_dice") for k in names])
    return p.join(lesion_level(df, ["fold"]).select("fold", "micro", "macro"), "fold", "left").join(weighted, "fold").join(wide, "fold", "left")


def organ_arms(rows: DataFrame, by: list[str]) -> DataFrame:
    """By arm and organ: mean dice, detection rate 1 - missed / lesions and volume missed per region; rows as for organ_level, with fn_lesions."""
    rate = 1 - ratio(F.col("fn_lesions"), F.col("gt_lesions"))
    return rows.withColumn("organ", F.explode("tags")).groupBy(*by, "organ").agg(F.avg("dice").alias("dice"), F.avg(rate).alias("detection_rate"), F.avg("fn_vol").alias("fn"))


def region_table(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """organ (overall, liver, lung, bone, hr_bone), tracer (ALL too), dice, fp_vol, fn_vol, n.

    Dice is the cases' own, of those with a region of the organ; the volumes
    are means of each case's means over its regions. Cases without a label (gt
    = 0) are left out. rows: case_id, tags, fp_vol, fn_vol; cases: case_id,
    tracer, dice, gt.
    """
    organ = F.explode(F.concat(F.array(F.lit("overall")), F.col("tags")))
    per = rows.withColumn("organ", organ).groupBy("case_id", "organ").agg(F.avg("fp_vol").alias("fp_vol"), F.avg("fn_vol").alias("fn_vol"))
    both = per.join(cases.where("gt > 0").select("case_id", "dice", F.explode(F.array(F.lit("ALL"), F.col("tracer"))).alias("tracer")), "case_id")
    return both.groupBy("organ", "tracer").agg(F.avg("dice").alias("dice"), F.avg("fp_vol").alias("fp_vol"), F.avg("fn_vol").alias("fn_vol"), F.count("*").alias("n"))


def resolve_diagnosis(cases: DataFrame, known: DataFrame, lesion_free: DataFrame) -> DataFrame:
    """case_name, diagnosis, diseased: NEGATIVE and not diseased for known cases without lesions, PROSTATE_CANCER for PSMA, else the metadata's, else null."""
    free = lesion_free.select("case_name").distinct().withColumn("free", F.lit(True))
    out = cases.select("case_name", "tracer").distinct().join(known.select("case_name", F.col("diagnosis").alias("known")).dropDuplicates(["case_name"]), "case_name", "left").join(free, "case_name", "left")
    diagnosis = F.when(F.col("free"), "NEGATIVE").when(F.col("tracer") == "PSMA", "PROSTATE_CANCER").otherwise(F.col("known"))
    return out.select("case_name", diagnosis.alias("diagnosis"), F.col("free").isNull().alias("diseased"))


def non_diseased_cases(*parts: DataFrame) -> DataFrame:
    """case_name of the distinct cases that have TP + FN = 0 in any of the parts (case_name, tp, fn), such as validation and test."""
    rows = parts[0].select("case_name", "tp", "fn")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("case_name", "tp", "fn"))
    return rows.where("tp + fn = 0").select("case_name").distinct()


def efficiency_curve(df: DataFrame, by: list[str]) -> DataFrame:
    """Lesion figures by group and train_size, and as `ceiling` the micro sensitivity at the tracer's largest budget."""
    out = lesion_level(df, [*by, "tracer", "train_size"])
    return out.withColumn("ceiling", F.max_by("micro", "train_size").over(Window.partitionBy("tracer")))


def fold_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(F.round(F.avg("dice"), 4).alias("dice"), F.round(F.avg("false_pos_vol"), 2).alias("fp_vol"), F.round(F.avg("false_neg_vol"), 2).alias("fn_vol"), F.count("*").alias("n"))


def group_summary(df: DataFrame, by: str) -> DataFrame:
    """As fold_summary by fold and another column; rows without it are left out."""
    return df.where(F.col(by).isNotNull()).groupBy("fold", by).agg(F.round(F.avg("dice"), 4).alias("dice"), F.round(F.avg("false_pos_vol"), 2).alias("fp_vol"), F.round(F.avg("false_neg_vol"), 2).alias("fn_vol"), F.count("*").alias("n"))


def only_diseased(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("case_name")
    return df.withColumn("_s", F.sum("num_gt_lesions").over(w)).where("_s > 0").drop("_s")


def diff_map(base: DataFrame, new: DataFrame, keys: list[str], by: list[str], metrics: list[str]) -> DataFrame:
    """Means of new - base by group, over rows joined null-safely on all keys."""
    a, b = base.select(*keys, *[F.col(m).alias(m + "_a") for m in metrics]), new.select(*keys, *[F.col(m).alias(m + "_b") for m in metrics])
    right = b.withColumnsRenamed({k: "_" + k for k in keys})
    on = None
    for k in keys:
        on = a[k].eqNullSafe(right["_" + k]) if on is None else on & a[k].eqNullSafe(right["_" + k])
    both = a.join(right, on)
    return both.groupBy(*by).agg(*[F.avg(F.col(m + "_b") - F.col(m + "_a")).alias(m) for m in metrics], F.count("*").alias("n"))


def annotate_train_size(df: DataFrame, offset: int = 0) -> DataFrame:
    """Adds train_size by tracer and fold number plus offset; null out of range."""
    sizes = [F.when(F.col("tracer") == t, F.get(F.array(*[F.lit(x) for x in v]), F.col("fold_num") + offset)) for t, v in TRAIN_SIZES.items()]
    return df.withColumn("train_size", F.coalesce(*sizes))


def diff_heatmap(df: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(metric))


def describe(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    q = lambda p: F.percentile(name, F.lit(p))
    return df.groupBy(*by).agg(F.count(name).alias("n"), F.avg(name).alias("mean"), q(0.5).alias("median"), F.stddev_samp(name).alias("std"), F.var_samp(name).alias("var"), (q(0.75) - q(0.25)).alias("iqr"), F.max(name).alias("max"), *[q(k / 10).alias(f"p{k}0") for k in range(1, 10)])


def replicate_spread(df: DataFrame, metric: str, by: list[str]) -> DataFrame:
    per = df.groupBy(*by, "fold").agg(F.avg(metric).alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def tracer_dice(df: DataFrame) -> DataFrame:
    out = df.where("num_gt_lesions > 0").rollup("tracer").agg(F.avg("dice").alias("dice"), F.count("*").alias("n"))
    return out.withColumn("tracer", F.coalesce("tracer", F.lit("ALL")))


def voxel_error_sums(df: DataFrame) -> DataFrame:
    """By fold and tracer, and by fold over all tracers."""
    out = df.groupingSets([["fold"], ["fold", "tracer"]], "fold", "tracer").agg(F.avg("dice").alias("dice"), F.sum("false_pos_vol").alias("fp"), F.sum("false_neg_vol").alias("fn"), F.count("*").alias("n"))
    return out.withColumn("tracer", F.coalesce("tracer", F.lit("ALL")))


def mm3_to_cm3(df: DataFrame) -> DataFrame:
    """Divides every column whose name speaks of a volume by 1000."""
    names = [n for n in df.columns if "volume" in n.lower() or "vol" in n.lower() or n.endswith("mm3")]
    return df.withColumns({n: F.col(n) / 1000 for n in names})


def ranked(df: DataFrame, by: list[str], metric: str, then: str, descending: bool = False) -> DataFrame:
    """Adds rank, 1, 2, ... by the metric and then by `then`, nulls last; a group is ordered bucket by bucket, not in one task."""
    rows = df.withColumn("_key", -F.col(metric) if descending else F.col(metric))
    return numbered(rows, "_key", [then], "rank", by=tuple(by)).drop("_key")


def rank_quartile(rank: Column, n: Column) -> Column:
    """Quartile of a rank by linear cut points: 1 to 4."""
    return F.greatest(F.lit(1), F.floor(((rank - 1) * 4 + n - 2) / F.greatest(n - 1, F.lit(1)))).cast("int")
