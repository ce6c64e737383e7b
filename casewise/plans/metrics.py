"""Registered queries on per-case metrics, files, joins and paired tests, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.operators import paired as T
from casewise.operators import rollups as A
from casewise.operators import voxels as V
from casewise.plans import tails as TL
from casewise.plans.voxels import GRID, MM3, OVER, REGM, _flags
from casewise.sources import files as S
from casewise.sources.fixtures import VOXEL_ML, ctes, fixture
from casewise.streaming import incremental as I

Q: dict = {}
SQL: dict[str, str] = {}
CM = ctes("fx_case_metrics")
UN = ctes("fx_uncertainty")
SPL = ctes("fx_cases", "fx_splits")
CAS = ctes("fx_cases")
REG = ctes("fx_vox", "fx_regions")


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cm(spark, d):
    return fixture(spark, d, "fx_case_metrics")


def _un(spark, d):
    return fixture(spark, d, "fx_uncertainty")


def _r(df, *skip):
    """Every double column to six digits."""
    return df.withColumns({n: F.round(n, 6) for n, t in df.dtypes if t == "double" and n not in skip})


def ci(n: str) -> str:
    return f"count({n}) as {n}_n, round(avg({n}), 6) as {n}_mean, round(stddev_samp({n}), 6) as {n}_std, round(avg({n}) - 1.96 * stddev_samp({n}) / sqrt(count({n})), 6) as {n}_low, round(avg({n}) + 1.96 * stddev_samp({n}) / sqrt(count({n})), 6) as {n}_high"


@query("a1_mean_ci", CM + f" select fold, {ci('false_pos_vol')} from fx_case_metrics group by fold")
def a1(spark, d):
    return _r(_cm(spark, d).groupBy("fold").agg(*A.mean_ci("false_pos_vol")))


@query("a2_image_summary", CM + f" select fold, coalesce(tracer, 'All') as tracer, {ci('dice')}, {ci('false_pos_vol')} from fx_case_metrics group by grouping sets ((fold), (fold, tracer))")
def a2(spark, d):
    return _r(A.image_summary(_cm(spark, d), ["dice", "false_pos_vol"]))


DET = "count(distinct case_name) as images, sum(num_gt_lesions)::bigint as lesions, sum(num_gt_lesions - false_missed_lesions)::bigint as tp, sum(false_detected_lesions)::bigint as fp, sum(false_missed_lesions)::bigint as fn, round(sum(num_gt_lesions - false_missed_lesions) / nullif(sum(num_gt_lesions), 0), 6) as sensitivity, round(sum(num_pred_lesions - false_detected_lesions) / nullif(sum(num_pred_lesions), 0), 6) as ppv"


SPREAD = ", ".join(f"round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std" for c in ("dice", "false_pos_vol", "false_neg_vol", "num_gt_lesions", "num_pred_lesions", "false_missed_lesions", "false_detected_lesions", "case_sensitivity"))


@query("a3_detection_summary", CM + f" select fold, tracer, {DET}, {SPREAD} from (select *, (num_gt_lesions - false_missed_lesions) / nullif(num_gt_lesions, 0) as case_sensitivity from fx_case_metrics) group by 1, 2")
def a3(spark, d):
    return _r(A.detection_summary(_cm(spark, d), ["fold", "tracer"]))


@query("a4_segment_summary", REG + OVER + " select label % 5 as band, label % 3 as tracer, round(avg(gt_mm3), 6) as gt_mm3_mean, round(stddev_samp(gt_mm3), 6) as gt_mm3_std, round(avg(pred_mm3), 6) as pred_mm3_mean, round(stddev_samp(pred_mm3), 6) as pred_mm3_std from ov group by 1, 2")
def a4(spark, d):
    o = V.region_overlap(fixture(spark, d, "fx_vox"), MM3).withColumns({"band": F.col("label") % 5, "tracer": F.col("label") % 3})
    return _r(A.segment_summary(o, ["band", "tracer"], ["gt_mm3", "pred_mm3"]))


@query("a5_high_risk_summary", REG + OVER + f", p as (select case_id, is_bone, count(*) filter (hr_ground) as hr_gt, count(*) filter (hr_pred) as hr_pr, coalesce(count(*) filter (hr_ground and hr_pred) / nullif(count(*) filter (hr_ground), 0), 0) as hr_sens from fl join fx_regions using (label) group by 1, 2) select is_bone, {ci('hr_gt')}, {ci('hr_pr')}, {ci('hr_sens')} from p group by 1")
def a5(spark, d):
    return _r(A.high_risk_summary(_flags(spark, d).join(fixture(spark, d, "fx_regions"), "label"), ["is_bone"]))


@query("a6_liver_summary", REG + OVER + " select case_id % 3 as g, round(avg(hr_ground::int) * 100, 6) as hr_gt_percent, round(avg(hr_pred::int) * 100, 6) as hr_pred_percent, round(count(*) filter (hr_ground and hr_pred) / nullif(count(*) filter (hr_ground), 0), 6) as sensitivity, round(avg(gt_mm3), 6) as gt_mean, round(stddev_samp(gt_mm3), 6) as gt_std from fl where label = 5 group by 1")
def a6(spark, d):
    return _r(A.liver_summary(_flags(spark, d).where("label = 5").withColumn("g", F.col("case_id") % 3), ["g"]))


PAT = "count(*) as cases, count(*) filter (diseased) as n_diseased, round(avg(case when diseased then dice end), 6) as dice, round(avg(false_pos_vol), 6) as fp_mean, round(sum(false_pos_vol), 6) as fp_total, round(avg(case when diseased then false_neg_vol end), 6) as fn_mean, round(sum(case when diseased then false_neg_vol end), 6) as fn_total, round(count(*) filter (diseased and num_pred_lesions > 0) / nullif(count(*) filter (diseased), 0), 6) as sensitivity, round(count(*) filter (not diseased and not num_pred_lesions > 0) / nullif(count(*) filter (not diseased), 0), 6) as specificity"
LES = "sum(num_gt_lesions)::bigint as gt, sum(num_gt_lesions - false_missed_lesions)::bigint as detected, round(sum(num_gt_lesions - false_missed_lesions) / nullif(sum(num_gt_lesions), 0), 6) as micro, round(avg((num_gt_lesions - false_missed_lesions) / nullif(num_gt_lesions, 0)), 6) as macro, round(sum(false_detected_lesions) / count(*), 6) as fp_per_case, round(sum(false_detected_lesions) / nullif(sum(num_pred_lesions), 0), 6) as fdr"


@query("a7_patient_level", CM + f" select fold, tracer, {PAT} from fx_case_metrics group by 1, 2")
def a7(spark, d):
    return _r(A.patient_level(_cm(spark, d), ["fold", "tracer"]))


@query("a8_lesion_level", CM + f" select fold, diagnosis, {LES} from fx_case_metrics where diseased group by 1, 2")
def a8(spark, d):
    return _r(A.lesion_level(_cm(spark, d), ["fold", "diagnosis"]))


TAGS = ", tg as (select m.*, o.gt_mm3, o.pred_mm3, description, is_bone, hr_ground, unnest(list_filter([case when contains(description, 'liver') then 'liver' end, case when contains(description, 'lung') then 'lung' end, case when is_bone then 'bone' end, case when is_bone and hr_ground then 'hr_bone' end], lambda x: x is not null)) as organ from rm m join fl o on o.case_id = m.case_id and o.label = m.ts join fx_regions r on r.label = m.ts)"


def _tagged(spark, d):
    v = fixture(spark, d, "fx_vox")
    rows = V.region_metrics(v, VOXEL_ML).withColumnRenamed("ts", "label").join(_flags(spark, d).drop("n"), ["case_id", "label"]).join(fixture(spark, d, "fx_regions"), "label")
    return rows.withColumn("tags", A.region_tags(F.col("description"), F.col("is_bone"), F.col("hr_ground")))


@query("p8_region_tags", REG + OVER + REGM + TAGS + " select organ, count(*) as n from tg group by 1")
def p8(spark, d):
    return _tagged(spark, d).select(F.explode("tags").alias("organ")).groupBy("organ").agg(F.count("*").alias("n"))


@query("p9_overlap_gate", VOX_OVER := ctes("fx_vox") + OVER + " select case_id, label from ov where gt_mm3 / 1000 > 2.0 or pred_mm3 / 1000 > 2.0")
def p9(spark, d):
    return A.overlap_gate(V.region_overlap(fixture(spark, d, "fx_vox"), MM3), 2.0).select("case_id", "label")


@query("a9_organ_level", REG + OVER + REGM + TAGS + " select organ, count(*) as n, round(avg(dice), 6) as dice, round(avg(fp_vol), 6) as fp_mean, round(sum(fp_vol), 6) as fp_total, round(avg(fn_vol), 6) as fn_mean, round(sum(fn_vol), 6) as fn_total, sum(gt_lesions)::bigint as lesions from tg where gt_mm3 / 1000 > 0.4 or pred_mm3 / 1000 > 0.4 group by 1")
def a9(spark, d):
    return _r(A.organ_level(A.overlap_gate(_tagged(spark, d), 0.4).withColumn("dice", F.round("dice", 6)), []))


ORGANS = ["liver", "lung", "bone", "hr_bone"]
WIDE = ", ".join(f"round(sum(d * n) filter (organ = '{k}') / sum(n) filter (organ = '{k}' and d is not null), 6) as {k}_dice" for k in ORGANS)


@query("a10_arm_summary", ctes("fx_case_metrics", "fx_vox", "fx_regions") + OVER + REGM + TAGS + f", og as (select 'fold_' || (case_id % 7)::varchar as fold, case_id % 3 as tr, organ, count(*) as n, avg(dice) as d from tg group by 1, 2, 3), wide as (select fold, {WIDE} from og group by 1), p as (select fold, {PAT} from fx_case_metrics group by 1), l as (select fold, {LES} from fx_case_metrics where diseased group by 1), w as (select fold, round(sum(m * n) / sum(n), 6) as weighted_dice from (select fold, tracer, avg(case when diseased then dice end) as m, count(*) filter (diseased) as n from fx_case_metrics group by 1, 2) group by 1) select fold, dice, fp_mean, fn_mean, sensitivity, specificity, micro, macro, weighted_dice, liver_dice, lung_dice, bone_dice, hr_bone_dice from p left join l using (fold) join w using (fold) left join wide using (fold)")
def a10(spark, d):
    rows = _tagged(spark, d).withColumns({"dice": F.round("dice", 6), "fold": F.concat(F.lit("fold_"), (F.col("case_id") % 7).cast("string")), "tr": F.col("case_id") % 3})
    return _r(A.arm_summary(_cm(spark, d), A.organ_level(rows, ["fold", "tr"]), ORGANS))


FS = "round(avg(dice), 4) as dice, round(avg(false_pos_vol), 2) as fp_vol, round(avg(false_neg_vol), 2) as fn_vol, count(*) as n"


@query("a11_fold_summary", CM + f" select fold, {FS} from fx_case_metrics group by 1")
def a11(spark, d):
    return A.fold_summary(_cm(spark, d))


@query("a12_group_summary", CM + f" select fold, diagnosis, {FS} from fx_case_metrics group by 1, 2")
def a12(spark, d):
    return A.group_summary(_cm(spark, d), "diagnosis")


@query("a13_region_table", REG + OVER + REGM + TAGS + ", cs as (select case_id, coalesce(2 * sum(gt * pred) / nullif(sum(gt) + sum(pred), 0), 0) as dice, sum(gt) as gt, case when case_id % 3 = 0 then 'psma' else 'fdg' end as tr from fx_vox group by case_id), ro as (select case_id, organ, fp_vol, fn_vol from tg union all select case_id, 'overall', fp_vol, fn_vol from rm), pc as (select case_id, organ, avg(fp_vol) as fp, avg(fn_vol) as fn from ro group by 1, 2) select organ, coalesce(tr, 'ALL') as tracer, round(avg(dice), 6) as dice, round(avg(fp), 6) as fp_vol, round(avg(fn), 6) as fn_vol, count(*) as n from pc join cs using (case_id) where gt > 0 group by grouping sets ((organ), (organ, tr))")
def a13(spark, d):
    v = fixture(spark, d, "fx_vox")
    tracer = F.when(F.col("case_id") % 3 == 0, "psma").otherwise("fdg")
    cases = V.confusion_counts(v, GRID).select("case_id", tracer.alias("tracer"), V.dice(F.col("tp"), F.col("fp"), F.col("fn"), 0.0).alias("dice"), (F.col("tp") + F.col("fn")).alias("gt"))
    return _r(A.region_table(_tagged(spark, d), cases))


@query("a14_fold_metrics", CM + " select fold, round(avg(case when num_gt_lesions > 0 then dice end), 6) as dice, round(avg(false_pos_vol), 6) as fp_mean, round(sum(false_pos_vol), 6) as fp_total, round(avg(false_neg_vol), 6) as fn_mean, round(sum(false_neg_vol), 6) as fn_total, sum(num_pred_lesions)::bigint as predicted from fx_case_metrics group by 1")
def a14(spark, d):
    return _r(_cm(spark, d).groupBy("fold").agg(F.avg(F.when(F.col("num_gt_lesions") > 0, F.col("dice"))).alias("dice"), F.avg("false_pos_vol").alias("fp_mean"), F.sum("false_pos_vol").alias("fp_total"), F.avg("false_neg_vol").alias("fn_mean"), F.sum("false_neg_vol").alias("fn_total"), F.sum("num_pred_lesions").alias("predicted")))


@query("a15_only_diseased", CM + " select case_name, fold from fx_case_metrics qualify sum(num_gt_lesions) over (partition by case_name) > 0")
def a15(spark, d):
    return A.only_diseased(_cm(spark, d)).select("case_name", "fold")


@query("a16_region_case_lists", ctes("fx_vox") + OVER + " select distinct label, case_id from ov where gt_mm3 / 1000 > 1")
def a16(spark, d):
    return V.region_overlap(fixture(spark, d, "fx_vox"), MM3).where(F.col("gt_mm3") / 1000 > 1).select("label", "case_id").distinct()


DIFF = CM + ", a as (select * from fx_case_metrics where fold_num = 0), b as (select * from fx_case_metrics where fold_num = 5), j as (select a.diseased, a.tracer, b.dice - a.dice as dd, b.false_pos_vol - a.false_pos_vol as fp from a join b on a.case_name = b.case_name and a.tracer is not distinct from b.tracer and a.diseased is not distinct from b.diseased and a.diagnosis is not distinct from b.diagnosis)"


def _diff(spark, d, by):
    c = _cm(spark, d)
    return A.diff_map(c.where("fold_num = 0"), c.where("fold_num = 5"), ["case_name", "tracer", "diseased", "diagnosis"], by, ["dice", "false_pos_vol"])


@query("a17_diff_map", DIFF + " select diseased, tracer, round(avg(dd), 6) as dice, round(avg(fp), 6) as false_pos_vol, count(*) as n from j group by 1, 2")
def a17(spark, d):
    return _r(_diff(spark, d, ["diseased", "tracer"]))


@query("a18_collapse_duplicates", CM + " select case_name, tracer, round(avg(dice), 6) as dice, round(avg(false_pos_vol), 6) as false_pos_vol from fx_case_metrics group by 1, 2")
def a18(spark, d):
    return _r(_cm(spark, d).groupBy("case_name", "tracer").agg(F.avg("dice").alias("dice"), F.avg("false_pos_vol").alias("false_pos_vol")))


@query("a19_diff_heatmap", CM + """ select fold, round(avg(false_pos_vol) filter (diagnosis = 'NEGATIVE'), 6) as "NEGATIVE", round(avg(false_pos_vol) filter (diagnosis = 'LYMPHOMA'), 6) as "LYMPHOMA" from fx_case_metrics group by 1""")
def a19(spark, d):
    return _r(A.diff_heatmap(_cm(spark, d), "fold", "diagnosis", ["NEGATIVE", "LYMPHOMA"], "false_pos_vol"))


@query("a20_describe", CM + " select tracer, count(dice) as n, round(avg(dice), 6) as mean, round(quantile_cont(dice, 0.5), 6) as median, round(stddev_samp(dice), 6) as std, round(var_samp(dice), 6) as var, round(quantile_cont(dice, 0.75) - quantile_cont(dice, 0.25), 6) as iqr, round(max(dice), 6) as max, " + ", ".join(f"round(quantile_cont(dice, {k / 10}), 6) as p{k}0" for k in range(1, 10)) + " from fx_case_metrics group by 1")
def a20(spark, d):
    return _r(A.describe(_cm(spark, d), "dice", ["tracer"]))


@query("a21_replicate_spread", CM + " select tracer, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as std from (select tracer, fold, avg(dice) as m from fx_case_metrics where fold_num < 5 group by 1, 2) group by 1")
def a21(spark, d):
    return _r(A.replicate_spread(_cm(spark, d).where("fold_num < 5"), "dice", ["tracer"]))


@query("a22_tracer_dice", CM + " select coalesce(tracer, 'ALL') as tracer, round(avg(dice), 6) as dice, count(*) as n from fx_case_metrics where num_gt_lesions > 0 group by rollup (tracer)")
def a22(spark, d):
    return _r(A.tracer_dice(_cm(spark, d)))


@query("a23_voxel_error_sums", CM + " select fold, coalesce(tracer, 'ALL') as tracer, round(avg(dice), 6) as dice, round(sum(false_pos_vol), 6) as fp, round(sum(false_neg_vol), 6) as fn, count(*) as n from fx_case_metrics group by grouping sets ((fold), (fold, tracer))")
def a23(spark, d):
    return _r(A.voxel_error_sums(_cm(spark, d)))


SIZES = ", sz(tracer, k, train_size) as (select * from (values ('FDG',0,6),('FDG',1,33),('FDG',2,66),('FDG',3,72),('FDG',4,99),('FDG',5,132),('FDG',6,199),('FDG',7,265),('FDG',8,332),('PSMA',0,3),('PSMA',1,18),('PSMA',2,37),('PSMA',3,40),('PSMA',4,55),('PSMA',5,75),('PSMA',6,113),('PSMA',7,151),('PSMA',8,189)) v)"


@query("p6_annotate_train_size", CM + SIZES + " select case_name, fold_num, c.tracer, train_size from fx_case_metrics c left join sz on sz.tracer = c.tracer and sz.k = fold_num + 2")
def p6(spark, d):
    return A.annotate_train_size(_cm(spark, d), 2).select("case_name", "fold_num", "tracer", "train_size")


ARMS = "case when fold_num = 5 then 'selected' when fold_num < 5 then 'random' else 'spare' end"


def _arms(spark, d):
    n = F.col("fold_num")
    return _cm(spark, d).withColumn("arm", F.when(n == 5, "selected").when(n < 5, "random").otherwise("spare"))


@query("a24_efficiency_curve", CM + SIZES + f", s as (select c.*, {ARMS} as arm, train_size from fx_case_metrics c join sz on sz.tracer = c.tracer and sz.k = fold_num where diseased), g as (select arm, tracer, train_size, sum(num_gt_lesions - false_missed_lesions) / nullif(sum(num_gt_lesions), 0) as full_micro, {LES} from s group by 1, 2, 3), top as (select tracer, arg_max(full_micro, train_size) as ceiling from g group by 1) select g.* exclude (full_micro), round(ceiling, 6) as ceiling from g join top using (tracer)")
def a24(spark, d):
    return _r(A.efficiency_curve(A.annotate_train_size(_arms(spark, d)), ["arm"]))


@query("p12_budget_arm", CM + f" select {ARMS} as arm, count(*) as n from fx_case_metrics group by 1")
def p12(spark, d):
    return _arms(spark, d).groupBy("arm").agg(F.count("*").alias("n"))


@query("a25_organ_arms", REG + OVER + REGM + TAGS + " select case when case_id % 2 = 0 then 'selected' else 'random' end as arm, organ, round(avg(dice), 6) as dice, round(avg(1 - fn_lesions / nullif(gt_lesions, 0)), 6) as detection_rate, round(avg(fn_vol), 6) as fn from tg group by 1, 2")
def a25(spark, d):
    rows = _tagged(spark, d).withColumn("dice", F.round("dice", 6)).withColumn("arm", F.when(F.col("case_id") % 2 == 0, "selected").otherwise("random"))
    return _r(A.organ_arms(rows, ["arm"]))


@query("p11_derived_lesion_columns", CM + " select case_name, fold, num_gt_lesions - false_missed_lesions as detected, round((num_gt_lesions - false_missed_lesions) / nullif(num_gt_lesions, 0), 6) as case_sensitivity, round(1 - false_missed_lesions / nullif(num_gt_lesions, 0), 6) as detection_rate from fx_case_metrics")
def p11(spark, d):
    return _r(A.derived_lesion_columns(_cm(spark, d)).select("case_name", "fold", "detected", "case_sensitivity", "detection_rate"))


@query("p3_resolve_diagnosis", CM + " select case_name, case when max(num_gt_lesions) = 0 then 'NEGATIVE' when max(tracer) = 'PSMA' then 'PROSTATE_CANCER' when case_name % 4 = 0 then max(diagnosis) end as diagnosis, max(num_gt_lesions) > 0 as diseased from fx_case_metrics group by case_name")
def p3(spark, d):
    c = _cm(spark, d)
    free = c.groupBy("case_name").agg(F.max("num_gt_lesions").alias("most")).where("most = 0")
    return A.resolve_diagnosis(c, c.where("case_name % 4 = 0"), free)


@query("p4_non_diseased_cases", CM + " select case_name from fx_case_metrics where fold_num < 5 and num_gt_lesions = 0 union select case_name from fx_case_metrics where fold_num = 6 and num_gt_lesions = 0")
def p4(spark, d):
    c = _cm(spark, d).select("case_name", "fold_num", (F.col("num_gt_lesions") - F.col("false_missed_lesions")).alias("tp"), F.col("false_missed_lesions").alias("fn"))
    return A.non_diseased_cases(c.where("fold_num < 5"), c.where("fold_num = 6"))


@query("p5_mm3_to_cm3", CM + " select case_name, fold, round(false_pos_vol / 1000, 6) as false_pos_vol, round(false_neg_vol / 1000, 6) as false_neg_vol from fx_case_metrics")
def p5(spark, d):
    return _r(A.mm3_to_cm3(_cm(spark, d).select("case_name", "fold", "false_pos_vol", "false_neg_vol")))


@query("p7_label_segments", REG + " select case_id, x, y, z, case when is_bone then 'Bone' when description like 'liver%' or description like 'lung%' then 'Organ' else 'Other' end as kind, coalesce(description, ts::varchar) as name from fx_vox left join fx_regions on ts = label")
def p7(spark, d):
    v = fixture(spark, d, "fx_vox").join(fixture(spark, d, "fx_regions"), F.col("ts") == F.col("label"), "left")
    kind = F.when(F.col("is_bone"), "Bone").when(F.col("description").rlike("^(liver|lung)"), "Organ").otherwise("Other")
    return v.select("case_id", "x", "y", "z", kind.alias("kind"), F.coalesce("description", F.col("ts").cast("string")).alias("name"))


@query("p10_filter_cases", ctes("fx_case_metrics", "fx_cases", "fx_splits") + " select case_name, fold from fx_case_metrics where case_name in (select case_id from fx_splits where role = 'train') and case_name not in (select case_id from fx_splits where role = 'val')")
def p10(spark, d):
    s = fixture(spark, d, "fx_splits")
    pick = lambda r: s.where(f"role = '{r}'").select(F.col("case_id").alias("case_name")).distinct()
    return _cm(spark, d).join(pick("train"), "case_name", "left_semi").join(pick("val"), "case_name", "left_anti").select("case_name", "fold")


@query("j3_paired_inner", CM + " select a.case_name, round(a.dice, 6) as dice_a, round(b.dice, 6) as dice_b from fx_case_metrics a join fx_case_metrics b on a.case_name = b.case_name where a.fold_num = 1 and b.fold_num = 5")
def j3(spark, d):
    c = _cm(spark, d)
    pick = lambda k, s: c.where(f"fold_num = {k}").select("case_name", F.col("dice").alias("dice_" + s))
    return _r(pick(1, "a").join(pick(5, "b"), "case_name"))


@query("j4_left_dimension", CM + ", m as (select distinct case_name, diagnosis from fx_case_metrics where case_name % 2 = 0) select c.case_name, c.fold, m.diagnosis from fx_case_metrics c left join m using (case_name)")
def j4(spark, d):
    c = _cm(spark, d)
    m = c.where("case_name % 2 = 0").select("case_name", "diagnosis").dropDuplicates(["case_name"])
    return c.select("case_name", "fold").join(m, "case_name", "left")


@query("j5_full_outer", ctes("fx_vox") + ", g as (select case_id, ts, count(*) as gt_n from fx_vox where gt = 1 group by 1, 2), p as (select case_id, ts, count(*) as pred_n from fx_vox where pred = 1 group by 1, 2) select * from g full join p using (case_id, ts)")
def j5(spark, d):
    v = fixture(spark, d, "fx_vox")
    pick = lambda m: v.where(f"{m} = 1").groupBy("case_id", "ts").agg(F.count("*").alias(m + "_n"))
    return pick("gt").join(pick("pred"), ["case_id", "ts"], "full")


@query("j6_matched_fold", CM + " select a.case_name, a.fold_num, round(b.false_pos_vol - a.false_pos_vol, 6) as diff from fx_case_metrics a join fx_case_metrics b on a.case_name = b.case_name and b.fold_num = a.fold_num + 2")
def j6(spark, d):
    a = _cm(spark, d).select("case_name", "fold_num", F.col("false_pos_vol").alias("a"))
    b = _cm(spark, d).select("case_name", (F.col("fold_num") - 2).alias("fold_num"), F.col("false_pos_vol").alias("b"))
    return _r(a.join(b, ["case_name", "fold_num"]).select("case_name", "fold_num", (F.col("b") - F.col("a")).alias("diff")))


UCOLS = ["average_uncertainty", "average_uncertainty_predicted"]
DIS = UN + ", a as (select * from fx_uncertainty where method = 'm1'), b as (select * from fx_uncertainty where method = 'm2'), t as (select a.case_id, abs(a.average_uncertainty - b.average_uncertainty) as d1, abs(a.average_uncertainty_predicted - b.average_uncertainty_predicted) as d2, (a.dice + b.dice) / 2 as dm, abs(a.dice - b.dice) as dd from a join b using (case_id))"


@query("t11_method_disagreement", DIS + " select case_id, round(d1, 6) as average_uncertainty_diff, round(d2, 6) as average_uncertainty_predicted_diff, round((d1 + d2) / 2, 6) as disagreement, round(dm, 6) as dice_mean, round(dd, 6) as dice_diff from t")
def t11(spark, d):
    return _r(T.method_disagreement(_un(spark, d), "m1", "m2", UCOLS))


ENDS = "select '{kind}' as kind, case_id, d as disagreement from (select * from g order by d {way}, case_id limit 5)"


@query("t11_similar_dissimilar", DIS + ", g as (select case_id, round((d1 + d2) / 2, 6) as d from t where round(dm, 6) > 0.2::double) " + ENDS.format(kind="similar", way="asc") + " union all " + ENDS.format(kind="dissimilar", way="desc"))
def t11s(spark, d):
    return T.similar_and_dissimilar(_r(T.method_disagreement(_un(spark, d), "m1", "m2", UCOLS)), 0.2, 5)


@query("w5_top_k", DIS + " select case_id, round(dd, 6) as dice_diff from t order by round(dd, 6) desc, case_id limit 5")
def w5(spark, d):
    return _r(T.method_disagreement(_un(spark, d), "m1", "m2", UCOLS)).select("case_id", "dice_diff").orderBy(F.desc("dice_diff"), "case_id").limit(5)


@query("w2_rank_first", CM + " select case_name, fold, cast(row_number() over (partition by fold order by false_pos_vol, case_name) as int) as rank from fx_case_metrics")
def w2(spark, d):
    return A.ranked(_cm(spark, d), ["fold"], "false_pos_vol", "case_name").select("case_name", "fold", "rank")


@query("w3_rank_quartile", CM + ", r as (select case_name, fold, row_number() over (partition by fold order by false_pos_vol, case_name) as r, count(*) over (partition by fold) as n from fx_case_metrics) select case_name, fold, cast(greatest(1, ((r - 1) * 4 + n - 2) // greatest(n - 1, 1)) as int) as q from r")
def w3q(spark, d):
    sizes = _cm(spark, d).groupBy("fold").agg(F.count("*").alias("n"))
    r = A.ranked(_cm(spark, d), ["fold"], "false_pos_vol", "case_name").join(F.broadcast(sizes), "fold")  # one row per fold
    return r.select("case_name", "fold", A.rank_quartile(F.col("rank"), F.col("n")).alias("q"))


METRICS = ["dice", "false_pos_vol", "false_neg_vol"]
PAIRS = CM + ", pr as (" + " union all ".join(f"select case_name, '{m}' as metric, avg({m}) filter (fold_num < 5) as a, avg({m}) filter (fold_num = 5) as b from fx_case_metrics group by 1" for m in METRICS) + "), pt as (select *, b - a as diff from pr where a is not null and b is not null)"


def _pairs(spark, d):
    return T.paired_table(_cm(spark, d), [0, 1, 2, 3, 4], 5, METRICS)


@query("t1_paired_table", PAIRS + " select case_name, metric, round(a, 6) as a, round(b, 6) as b, round(diff, 6) as diff from pt")
def t1(spark, d):
    return _r(_pairs(spark, d))


@query("t2_paired_t", PAIRS + TL.t_columns("metric") + f" select metric, {TL.T_OUT} from tt")
def t2(spark, d):
    return _r(T.paired_t(_pairs(spark, d), ["metric"], sign=T.direction()))


@query("t3_wilcoxon", PAIRS + TL.rank_columns("metric") + f" select metric, {TL.W_OUT} from wx")
def t3(spark, d):
    return _r(T.wilcoxon(_pairs(spark, d), ["metric"], T.direction()))


@query("t4_bootstrap_ci", PAIRS + TL.bootstrap("metric", "pt", 10_000) + " select metric, round(low, 6) as low, round(high, 6) as high from bt")
def t4(spark, d):
    return _r(T.bootstrap_ci(_pairs(spark, d), ["metric"]))


# The quantile by halving: fifty steps over (-100, 100).
UCL = f", s as (select metric, count(*) as n, avg(diff) as mean, stddev_samp(diff) / sqrt(count(*)) as se from pt group by 1), qt(metric, n, k, lo, hi) as (select metric, n, 0, -100::double, 100::double from s union all select metric, n, k + 1, case when up then mid else lo end, case when up then hi else mid end from (select *, {TL.t_sf('mid', '(n - 1)')} > 0.05 as up from (select *, (lo + hi) / 2 as mid from qt where k < 50))), u as (select s.*, mean + (lo + hi) / 2 * se as ucl from s join qt using (metric) where k = 50)"


@query("t5_noninferiority", PAIRS + UCL + " select metric, n, round(mean, 6) as mean, round(se, 6) as se, round((mean - 0.05) / se, 6) as t_margin, round(ucl, 6) as ucl, ucl < 0.05 as noninferior from u")
def t5(spark, d):
    return _r(T.noninferiority(_pairs(spark, d), ["metric"], 0.05))


ARM = CM + ", pt as (" + " union all ".join(f"select a.fold_num as k, '{m}' as metric, a.case_name, a.{m} as a, b.{m} - a.{m} as diff from fx_case_metrics a join fx_case_metrics b on a.case_name = b.case_name and b.fold_num = a.fold_num + 2 where a.{m} is not null and b.{m} is not null{' and a.diseased and b.diseased' if m == 'false_neg_vol' else ''}" for m in METRICS) + ")"


def _arm_pairs(spark, d):
    return T.arm_pairs(_cm(spark, d), METRICS)


@query("t6_arm_tests", ARM + TL.t_columns("k, metric") + TL.rank_columns("k, metric") + " select k, metric, tt.n, round(mean, 6) as mean, round(sd, 6) as sd, round(t, 6) as t, round(tt.p, 6) as p, round(tt.p_better, 6) as p_better, round(w_plus, 6) as w_plus, round(z, 6) as z, round(wx.p, 6) as w_p, round(wx.p_better, 6) as w_p_better from tt left join wx using (k, metric)")
def t6(spark, d):
    return _r(T.arm_tests(_arm_pairs(spark, d), ["k", "metric"]))


CASE = "(select distinct case_name, tracer, diseased from fx_case_metrics)"


@query("t9_run_many", PAIRS + f", ds as (select p.*, tracer as dataset from pt p join {CASE} c using (case_name))" + TL.t_columns("dataset, metric", "ds") + TL.rank_columns("dataset, metric", "ds") + TL.bootstrap("dataset, metric", "ds", 10_000) + " select dataset, metric, tt.n, round(mean, 6) as mean, round(sd, 6) as sd, round(t, 6) as t, round(tt.p, 6) as t_p, round(tt.p_better, 6) as t_p_better, round(w_plus, 6) as w_plus, round(z, 6) as z, round(wx.p, 6) as w_p, round(wx.p_better, 6) as w_p_better, round(low, 6) as low, round(high, 6) as high from tt left join wx using (dataset, metric) left join bt using (dataset, metric)")
def t9(spark, d):
    c = _cm(spark, d).select("case_name", F.col("tracer").alias("dataset")).distinct()
    return _r(T.run_many(_pairs(spark, d).join(c, "case_name"), ["dataset", "metric"], sign=T.direction()))


MEMBERS = f", mb as (select p.*, unnest(['overall', c.tracer, c.tracer || '/' || case when diseased then 'diseased' else 'healthy' end, case when diseased then 'diseased (all)' else 'healthy (all)' end]) as subgroup from pt p join {CASE} c using (case_name))"


@query("t7_subgroup_tests", PAIRS + MEMBERS + ", sb as (select * from mb where abs(diff) > 1e-9::double)" + TL.rank_columns("metric, subgroup", "sb") + f", s as (select metric, subgroup, count(*) as n, round(avg(diff), 6) as mean, round(quantile_cont(diff, 0.5), 6) as median, round(quantile_cont(diff, 0.25), 6) as q1, round(quantile_cont(diff, 0.75), 6) as q3, round(avg((diff * {TL.SIGN} > 0)::int), 6) as win_rate from sb group by 1, 2 having count(*) >= 3) select s.*, case when wx.n >= 5 then round(p, 6) end as p, case when wx.n >= 5 then round(p_better, 6) end as p_better from s left join wx using (metric, subgroup)")
def t7(spark, d):
    return _r(T.subgroup_summary(T.subgroup_members(_pairs(spark, d), _cm(spark, d)), ["metric", "subgroup"]))


@query("t8_stratified_improvement", ARM + MEMBERS + f", g as (select *, diff * {TL.SIGN} as gain from mb), r as (select *, row_number() over (partition by subgroup, k, metric order by round(a * {TL.SIGN}, 9), case_name) as r, count(*) over (partition by subgroup, k, metric) as c from g), sq as (select *, cast(greatest(1, ((r - 1) * 4 + c - 2) // greatest(c - 1, 1)) as int) as q from r where c >= 8)" + TL.rank_columns("subgroup, k, metric, q", "sq", "gain") + ", s as (select subgroup, k, metric, q, count(*) as n, round(quantile_cont(gain, 0.5), 6) as median, round(avg((gain > 0)::int) * 100, 6) as win, round(quantile_cont(a, 0.5), 6) as baseline from sq group by 1, 2, 3, 4) select s.*, round(p, 6) as p from s left join wx using (subgroup, k, metric, q)")
def t8(spark, d):
    return _r(T.stratified_improvement(T.subgroup_members(_arm_pairs(spark, d), _cm(spark, d)), ["subgroup", "k", "metric"]))


@query("t10_per_size_t", ARM + ", ps as (select * from pt where metric = 'false_pos_vol')" + TL.t_columns("k, metric", "ps") + f" select k, {TL.T_OUT} from tt")
def t10(spark, d):
    return _r(T.paired_t(_arm_pairs(spark, d).where("metric = 'false_pos_vol'"), ["k", "metric"], sign=T.direction()).drop("metric"))


def _split_rows(spark, d):
    from pyspark.sql import Window

    rows = fixture(spark, d, "fx_splits").withColumn("pos", F.row_number().over(Window.partitionBy("split_id", "role").orderBy("case_id")) - 1)
    return rows.select("split_id", "role", "pos", F.col("filename").alias("case"))


SPLIT_ROWS = SPL + ', p as (select split_id, role, cast(row_number() over (partition by split_id, role order by case_id) - 1 as int) as pos, filename as "case" from fx_splits) select * from p'


@query("s1_s2_split_files", SPLIT_ROWS)
def s1(spark, d):
    S.write_splits(_split_rows(spark, d), path := S.scratch(spark, "splits"))
    return S.read_splits(spark, path)


@query("s2_split_parts", SPLIT_ROWS)
def s2_parts(spark, d):
    S.write_split_parts(_split_rows(spark, d), path := S.scratch(spark, "split-parts"))
    return S.read_split_parts(spark, path)


@query("s3_read_summaries", "select 1::int as dataset, 'test' as split, (event_id % 3)::int as fold, 'fdg_' || event_id as \"case\", cast(regexp_extract(props, '\"k\": *(\\d+)', 1) as bigint) as tp, event_id % 7 as fp, event_id % 5 as fn, case when event_id % 3 = 0 then null else 0.5::double end as dice, 0.25::double as foreground_dice from events")
def s3(spark, d):
    e = fixture(spark, d, "events")
    one = F.format_string('{"foreground_mean": {"Dice": 0.25}, "metric_per_case": [{"prediction_file": "a/fdg_%d.nii.gz", "metrics": {"1": {"TP": %d, "FP": %d, "FN": %d, "Dice": %s}}}]}', "event_id", F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 7, F.col("event_id") % 5, F.when(F.col("event_id") % 3 == 0, "NaN").otherwise("0.5"))
    path = S.scratch(spark, "summaries") + "/Dataset001/test"
    e.select(one.alias("value"), F.concat(F.lit("fold_"), (F.col("event_id") % 3).cast("string")).alias("fold")).write.partitionBy("fold").text(path)
    return S.read_summaries(spark, f"{path}/*", lines=True)


@query("s4_s11_case_csvs", CM + " select case_name, tracer, fold_num, num_gt_lesions from fx_case_metrics")
def s4(spark, d):
    path = S.scratch(spark, "results")
    S.write_results(_cm(spark, d).select("case_name", "tracer", "fold_num", "num_gt_lesions"), path, ["tracer", "fold_num"])
    return S.read_case_csvs(spark, path, "case_name long, num_gt_lesions long, tracer string, fold_num int").select("case_name", "tracer", "fold_num", "num_gt_lesions")


@query("s5_read_lesion_metrics", CAS + " select replace(filename, '.nii.gz', '') as case_name, (case_id % 9)::int as num_gt_lesions from fx_cases")
def s5(spark, d):
    path = S.scratch(spark, "lesions")
    fixture(spark, d, "fx_cases").select(F.col("filename").alias("case_name"), (F.col("case_id") % 9).alias("num_gt_lesions")).write.option("header", True).csv(path)
    return S.read_lesion_metrics(spark, path, "case_name string, num_gt_lesions int")


@query("s6_diagnosis", CAS + " select distinct 'fdg_' || (case_id % 50)::varchar || '_' || (case_id % 3)::varchar as case_key, case when case_id % 50 < 20 then 'NEGATIVE' else 'LYMPHOMA' end as diagnosis from fx_cases")
def s6(spark, d):
    pid = F.col("case_id") % 50
    location = F.concat(F.lit("./data/PETCT_"), pid.cast("string"), F.lit("/"), (F.col("case_id") % 3).cast("string"), F.lit("/x"))
    path = S.scratch(spark, "diagnosis")
    fixture(spark, d, "fx_cases").select(location.alias("file_location"), F.when(pid < 20, "NEGATIVE").otherwise("LYMPHOMA").alias("diagnosis")).write.option("header", True).csv(path)
    return S.read_diagnosis(spark, path)


@query("s7_region_lookup", REG + " select label, description, is_bone from fx_regions")
def s7(spark, d):
    path = S.scratch(spark, "regions")
    fixture(spark, d, "fx_regions").select("label", F.concat(F.lit(" "), "description").alias("description"), "is_bone").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return S.read_region_lookup(spark, path)


@query("s9_case_inventory", CAS + " select case_id, case when case_id % 4 <> 0 then 'img/' || filename end as image, case when case_id % 6 <> 0 then 'ts/' || filename end as anatomy, concat_ws(',', case when case_id % 4 = 0 then 'image' end, case when case_id % 6 = 0 then 'anatomy' end) as missing from fx_cases")
def s9(spark, d):
    c = fixture(spark, d, "fx_cases")
    pick = lambda p, k: c.where(f"case_id % {k} <> 0").select(F.concat(F.lit(p), "filename").alias("path"))
    found = S.case_inventory(c.select("case_id", F.col("filename").alias("name")), {"image": pick("img/", 4), "anatomy": pick("ts/", 6)}, r"((?:fdg|psma)_\d+)")
    return found.withColumn("missing", F.concat_ws(",", "missing"))


@query("s10_log_metric", "select doc_id as name, cast(regexp_extract(text, '(\\d{3,9})', 1) as bigint) as value from documents where regexp_extract(text, '(\\d{3,9})', 1) <> ''")
def s10(spark, d):
    return S.extract_log_metric(fixture(spark, d, "documents").select(F.col("doc_id").alias("name"), "text"), r"(\d{3,9})")


JCOLS = [*UCOLS, "dice"]


def _json_sql() -> str:
    digits = lambda e: f"round({e}, 6)::decimal(18,6)::varchar"
    value = {"m1": lambda c: f"a.{c}", "m2": lambda c: f"b.{c}", "difference": lambda c: f"abs(a.{c} - b.{c})"}
    parts = ["'\"" + n + "\":{' || " + " || ',' || ".join("'\"" + c + "\":' || " + digits(f(c)) for c in JCOLS) + " || '}'" for n, f in value.items()]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


@query("s12_case_metrics_json", UN + f" select case_id, {_json_sql()} as json from (select * from fx_uncertainty where method = 'm1') a join (select * from fx_uncertainty where method = 'm2') b using (case_id)")
def s12(spark, d):
    return S.case_metrics_json(_un(spark, d), "m1", "m2", JCOLS)


@query("i1_pending_cases", CAS + " select case_id from fx_cases where case_id % 3 <> 0")
def i1(spark, d):
    c = fixture(spark, d, "fx_cases")
    return I.pending_cases(c, c.where("case_id % 3 = 0")).select("case_id")


@query("i1_tally", CAS + " select case when case_id % 5 = 0 then 'error' when case_id % 3 = 0 then 'ok' else 'missing' end as status, count(*) as n from fx_cases group by 1")
def i1t(spark, d):
    c = fixture(spark, d, "fx_cases")
    done = c.where("case_id % 3 = 0 or case_id % 5 = 0").withColumn("status", F.when(F.col("case_id") % 5 == 0, "error").otherwise("ok"))
    return I.tally(c, done)


@query("i2_stream_case_metrics", ctes("fx_vox") + " select case_id, round(coalesce(2.0 * sum(gt * pred) / nullif(sum(gt) + sum(pred), 0), 0), 6) as dice from fx_vox group by 1")
def i2(spark, d):
    src, out, mark = (S.scratch(spark, n) for n in ("arrivals", "metrics", "progress"))
    v = fixture(spark, d, "fx_vox").select("case_id", "x", "y", "z", "gt", "pred")
    v.repartition(4, "case_id").write.parquet(src)
    I.stream_case_metrics(spark, src, out, mark, "case_id long, x int, y int, z int, gt int, pred int", VOXEL_ML, GRID, 2)
    return _r(spark.read.parquet(out).select("case_id", "dice"))


@query("i3_split_case_stream", ctes("fx_vox") + " select case_id, 'ok' as status, round(coalesce(2.0 * sum(gt * pred) / nullif(sum(gt) + sum(pred), 0), 0), 6) as dice from fx_vox group by 1")
def i3(spark, d):
    """Every case in three files; two runs, each with some of them."""
    src, out, mark = (S.scratch(spark, n) for n in ("arrivals", "metrics", "progress"))
    vox = fixture(spark, d, "fx_vox").selectExpr("case_id", "z % 3 as part", "3 as parts", "x", "y", "z", "gt", "pred")
    empty = vox.select("case_id").distinct().selectExpr("case_id", "explode(array(0, 1, 2)) as part", "3 as parts", *[f"cast(null as int) as {c}" for c in ("x", "y", "z", "gt", "pred")])
    v = vox.unionByName(empty)  # also for parts without voxels
    for run in (0, 1):
        v.where(f"(case_id + part) % 2 = {run}").repartition(2, "part").write.mode("append").parquet(src)
        I.stream_split_cases(spark, src, out, mark, "long", VOXEL_ML, GRID, files_per_batch=2)
    return _r(spark.read.parquet(out).select("case_id", "status", "dice"))
