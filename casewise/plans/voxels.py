"""Registered queries on voxel tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.operators import voxels as V
from casewise.sources.files import scratch
from casewise.sources.fixtures import SHAPE, SPACING, VOXEL_ML, ctes, fixture
from casewise.sources.volumes import read_cases, read_volumes, write_volumes

Q: dict = {}
SQL: dict[str, str] = {}
GRID = SHAPE[0] * SHAPE[1] * SHAPE[2]
MM3 = 1600.0
VOX = ctes("fx_vox")
REG = ctes("fx_vox", "fx_regions")


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _vox(spark, d):
    return fixture(spark, d, "fx_vox")


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def comp_sql(mask: str, most: int, tag: str, region: bool = False, source: str = "fx_vox", where: str | None = None) -> str:
    """CTE cc_<tag>(case_id, ts, x, y, z, comp)."""
    same = " and a.ts = b.ts" if region else ""
    part = "case_id, ts" if region else "case_id"
    return f""", f_{tag} as (select case_id, {'ts' if source == 'fx_vox' else '0 as ts'}, x, y, z, (z * 16 + y) * 16 + x as v from {source} where {where or mask + ' = 1'}),
nb_{tag} as (select a.case_id, a.v, b.v as w from f_{tag} a join f_{tag} b on a.case_id = b.case_id{same} and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and abs(a.z - b.z) <= 1 and abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) between 1 and {most}),
r_{tag}(case_id, v, w) as (select case_id, v, v from f_{tag} union select r.case_id, r.v, n.w from r_{tag} r join nb_{tag} n on n.case_id = r.case_id and n.v = r.w),
cc_{tag} as (select f.*, cast(dense_rank() over (partition by {', '.join('f.' + p.strip() for p in part.split(','))} order by m.root) as int) as comp from f_{tag} f join (select case_id, v, min(w) as root from r_{tag} group by 1, 2) m on m.case_id = f.case_id and m.v = f.v)"""


def un_sql(mask: str, other: str, tag: str, region: bool = False) -> str:
    """cc and un_<tag>(case_id[, ts], n_components, n_unmatched, unmatched_voxels)."""
    part = "case_id, ts" if region else "case_id"
    j = " and c.ts = v.ts" if region else ""
    return comp_sql(mask, 2, tag, region) + f""", per_{tag} as (select {', '.join('c.' + p.strip() for p in part.split(','))}, comp, count(*) as n, max({other}) as hit from cc_{tag} c join fx_vox v on c.case_id = v.case_id and c.x = v.x and c.y = v.y and c.z = v.z{j} group by {', '.join('c.' + p.strip() for p in part.split(','))}, comp),
un_{tag} as (select {part}, count(*) as n_components, count(*) filter (hit = 0) as n_unmatched, cast(sum(case when hit = 0 then n else 0 end) as bigint) as unmatched_voxels from per_{tag} group by {part})"""


CONF = "count(*) filter (gt = 1 and pred = 1) as tp, count(*) filter (gt = 0 and pred = 1) as fp, count(*) filter (gt = 1 and pred = 0) as fn"


@query("v1_confusion_counts", VOX + f" select *, {GRID} - tp - fp - fn as tn from (select case_id, {CONF} from fx_vox group by case_id)")
def v1(spark, d):
    return V.confusion_counts(_vox(spark, d), GRID)


@query("v2_dice", VOX + f", c as (select case_id, ts, {CONF} from fx_vox group by 1, 2) select case_id, ts, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) end, 6) as dice_null, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as dice_zero, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 1 end, 6) as dice_one from c")
def v2(spark, d):
    c = V.confusion_counts(_vox(spark, d), GRID, ("case_id", "ts"))
    t = [F.col(k) for k in ("tp", "fp", "fn")]
    return c.select("case_id", "ts", *[F.round(V.dice(*t, e), 6).alias(n) for n, e in (("dice_null", None), ("dice_zero", 0.0), ("dice_one", 1.0))])


@query("v3_connected_components", VOX + comp_sql("gt", 2, "g") + " select case_id, x, y, z, comp from cc_g")
def v3(spark, d):
    return V.connected_components(_vox(spark, d), "gt")


@query("v4_false_positive_components", VOX + un_sql("pred", "gt", "p") + " select * from un_p")
def v4(spark, d):
    return V.unmatched_components(_vox(spark, d), "pred", "gt")


@query("v5_false_negative_components", VOX + un_sql("gt", "pred", "g") + " select * from un_g")
def v5(spark, d):
    return V.unmatched_components(_vox(spark, d), "gt", "pred")


@query("v6_lesion_count", VOX + comp_sql("gt", 3, "g") + " select case_id, max(comp) as n from cc_g group by 1")
def v6(spark, d):
    return V.connected_components(_vox(spark, d), "gt", 26).groupBy("case_id").agg(F.max("comp").alias("n"))


@query("v7_case_metrics", VOX + un_sql("pred", "gt", "p") + un_sql("gt", "pred", "g") + f", c as (select case_id, {CONF} from fx_vox group by 1) select s.s_suppkey as case_id, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as dice, coalesce(p.n_components, 0) as pred_lesions, coalesce(p.n_unmatched, 0) as false_detected, round(coalesce(p.unmatched_voxels * 1.6, 0), 6)::double as fp_vol, coalesce(g.n_components, 0) as gt_lesions, coalesce(g.n_unmatched, 0) as missed, round(coalesce(g.unmatched_voxels * 1.6, 0), 6)::double as fn_vol from supplier s left join c on c.case_id = s_suppkey left join un_p p on p.case_id = s_suppkey left join un_g g on g.case_id = s_suppkey")
def v7(spark, d):
    cases = fixture(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"))
    return _r(V.case_metrics(_vox(spark, d), cases, VOXEL_ML, GRID), "dice", "fp_vol", "fn_vol")


CLOSE = """, el as (select * from (values (0,0,-1),(0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1)) t(dx,dy,dz)),
grown as (select distinct case_id, x + dx as x, y + dy as y, z + dz as z from fx_vox, el where gt = 1 and x + dx between 0 and 15 and y + dy between 0 and 15 and z + dz between 1 and 7),
cells as (select t.case_id, t.x, t.y, t.z, count(*) filter (t.x + dx between 0 and 15 and t.y + dy between 0 and 15 and t.z + dz between 1 and 7) as want, count(g.case_id) as has from grown t cross join el left join grown g on g.case_id = t.case_id and g.x = t.x + dx and g.y = t.y + dy and g.z = t.z + dz group by 1, 2, 3, 4),
closed as (select case_id, x, y, z from cells where want = has)"""


@query("v3_tiled_components", VOX + comp_sql("gt", 2, "g") + " select case_id, x, y, z, comp from cc_g")
def v3t(spark, d):
    return V.connected_components(_vox(spark, d), "gt", tile=8)


@query("v4_tiled_unmatched", VOX + un_sql("pred", "gt", "p") + " select * from un_p")
def v4t(spark, d):
    return V.unmatched_components(_vox(spark, d), "pred", "gt", tile=8)


@query("v8_close_mask", VOX + CLOSE + " select * from closed")
def v8(spark, d):
    return V.close_mask(_vox(spark, d), "gt", SPACING, SHAPE)


@query("v9_lesion_candidates", VOX + CLOSE + comp_sql("m", 3, "c", source="closed", where="true") + " select case_id, x, y, z, comp from cc_c")
def v9(spark, d):
    return V.lesion_candidates(_vox(spark, d), "gt", SPACING, SHAPE)


@query("v9_tiled_candidates", VOX + CLOSE + comp_sql("m", 3, "c", source="closed", where="true") + " select case_id, x, y, z, comp from cc_c")
def v9t(spark, d):
    return V.lesion_candidates(_vox(spark, d), "gt", SPACING, SHAPE, tile=8)


def _grid(spark, d):
    """The shape and spacing of every case."""
    cases = fixture(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"))
    return cases.withColumns({**{f"n{k}": F.lit(n) for k, n in zip("xyz", SHAPE, strict=True)}, **{f"s{k}": F.lit(v) for k, v in zip("xyz", SPACING, strict=True)}})


@query("s13_volume_files", VOX + " select case_id, x, y, z, gt, pred from fx_vox")
def s13(spark, d):
    """Voxels as volumes (1 for an occupied one, 2 more for gt, 4 more for pred), written and read back."""
    vox, path = _vox(spark, d).selectExpr("case_id", "x", "y", "z - 1 as z", "1 + 2 * gt + 4 * pred as v"), scratch(spark, "volumes")
    write_volumes(vox, _grid(spark, d), path, "v")
    v = F.col("v").cast("int")
    back = read_volumes(spark, path).where("v > 0")
    return back.select(F.col("case_id").cast("long"), "x", "y", (F.col("z") + 1).alias("z"), (F.shiftright(v, 1) % 2).alias("gt"), F.shiftright(v, 2).alias("pred"))


@query("s14_volume_headers", f"select s_suppkey as case_id, {SHAPE[0]} as nx, {SHAPE[1]} as ny, {SHAPE[2]} as nz, {SPACING[0]}::double * {SPACING[1]} * {SPACING[2]} as voxel_mm3, 'int16' as kind, 'ok' as status from supplier")
def s14(spark, d):
    """Every case has a volume, also one without lesions; figures are from the headers alone."""
    path = scratch(spark, "volumes")
    write_volumes(_vox(spark, d).where("gt = 1 and z < 0"), _grid(spark, d), path, "gt", kind="int16")
    return read_cases(spark, path).select(F.col("case_id").cast("long"), "nx", "ny", "nz", (F.col("sx") * F.col("sy") * F.col("sz")).alias("voxel_mm3"), "kind", "status")


@query("v9_mask_volumes", VOX + CLOSE + comp_sql("m", 3, "c", source="closed", where="true") + " select case_id, x, y, z, comp from cc_c")
def v9m(spark, d):
    """Lesion candidates written as numbered mask volumes and read back."""
    path = scratch(spark, "masks")
    found = V.lesion_candidates(_vox(spark, d), "gt", SPACING, SHAPE).withColumn("z", F.col("z") - 1)
    write_volumes(found, _grid(spark, d), path, "comp", kind="uint16")
    back = read_volumes(spark, path).where("v > 0")
    return back.select(F.col("case_id").cast("long"), "x", "y", (F.col("z") + 1).alias("z"), F.col("v").cast("int").alias("comp"))


# Maps as whole numbers of 1 / 400: sums are exact in both engines and divided once, so the means are left unrounded.
MAPCOLS = "400 - 4 * p1_pct as p0, 4 * p1_pct as p1, 4 * unc_pct as total, (p1_pct % 4) * unc_pct as epistemic, 4 * unc_pct - (p1_pct % 4) * unc_pct as aleatoric"
MEANS = {f"{m}_{k}": f"sum({m}){w}::double / (400 * count({m}){w})::double" for m in V.MAPS for k, w in (("mean", ""), ("hit", " filter (hit is not null)"), ("false", " filter (hit is null)"))}


def lesion_sql(mask: str, other: str) -> str:
    means = ", ".join(f"case when count({n.split('_')[0]}){w} > 0 then {e} end as {n}" for (n, e), w in zip(MEANS.items(), ("", " filter (hit is not null)", " filter (hit is null)") * len(V.MAPS), strict=True))
    return VOX + comp_sql(mask, 2, "a") + comp_sql(other, 2, "b") + f""", j as (select a.case_id, a.comp as lesion, b.comp as hit, v.unc_pct, {MAPCOLS} from cc_a a left join cc_b b on a.case_id = b.case_id and a.v = b.v join fx_vox v on v.case_id = a.case_id and v.x = a.x and v.y = a.y and v.z = a.z),
k as (select case_id, lesion, count(*) as voxels, count(hit) as tp_voxels, {means}, array_to_string(list_sort(list(unc_pct) filter (hit is null)), ',') as fv, list_sort(list(distinct hit) filter (hit is not null)) as ids from j group by 1, 2)
select case_id, lesion, voxels, tp_voxels, voxels - tp_voxels as false_voxels, (voxels * 16 / 10)::double as volume, (tp_voxels * 16 / 10)::double as tp_volume, ((voxels - tp_voxels) * 16 / 10)::double as false_volume, round(tp_voxels * 100 / voxels, 6) as overlap_percent, tp_voxels * 100 / voxels > 1 as found, case when tp_voxels * 100 / voxels > 1 then array_to_string(ids, ',') end as ids, {", ".join(MEANS)}, coalesce(fv, '') as false_values from k"""


def _lesions(spark, d, mask, other):
    v = _vox(spark, d)
    p, u, part = 4 * F.col("p1_pct"), 4 * F.col("unc_pct"), (F.col("p1_pct") % 4) * F.col("unc_pct")
    out = V.lesions(v.withColumns({"p0": 400 - p, "p1": p, "total": u, "epistemic": part, "aleatoric": u - part}), mask, other, VOXEL_ML, scale=400)
    out = out.withColumn("false_values", F.array_join(F.transform("false_values", lambda x: F.round(x * 100).cast("long").cast("string")), ","))
    return _r(out, "volume", "tp_volume", "false_volume", "overlap_percent").withColumn("ids", F.array_join("ids", ","))


@query("v10_predicted_lesions", lesion_sql("pred", "gt"))
def v10(spark, d):
    return _lesions(spark, d, "pred", "gt")


@query("v11_ground_truth_lesions", lesion_sql("gt", "pred"))
def v11(spark, d):
    return _lesions(spark, d, "gt", "pred")


@query("v12_image_metrics", VOX + comp_sql("gt", 2, "g") + comp_sql("pred", 2, "p") + f", c as (select case_id, {CONF}, sum(unc_pct) filter (gt = 1)::double / (100 * count(*) filter (gt = 1))::double as ul, sum(unc_pct) filter (gt = 0)::double / (100 * ({GRID} - count(*) filter (gt = 1)))::double as ub, sum(p1_pct) filter (gt = 1)::double / (100 * count(*) filter (gt = 1))::double as pl, sum(p1_pct) filter (gt = 0)::double / (100 * ({GRID} - count(*) filter (gt = 1)))::double as pb from fx_vox group by 1) select c.case_id, tp, fp, fn, {GRID} - tp - fp - fn as tn, coalesce(g.n, 0) as gt_lesions, coalesce(p.n, 0) as pred_lesions, ul as unc_lesion, ub as unc_background, pl as prob_lesion, pb as prob_background, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as dice, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as sensitivity, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as ppv, ((tp + fn) * 16 / 10)::double as gt_volume, ((tp + fp) * 16 / 10)::double as pred_volume from c left join (select case_id, max(comp) as n from cc_g group by 1) g using (case_id) left join (select case_id, max(comp) as n from cc_p group by 1) p using (case_id)")
def v12(spark, d):
    return _r(V.image_metrics(_vox(spark, d), VOXEL_ML, GRID), "dice", "sensitivity", "ppv", "gt_volume", "pred_volume")


@query("v13_slice_background", VOX + ", s as (select distinct case_id, z from fx_vox where gt = 1), r as (select v.case_id, count(distinct v.z) * 256 - count(*) filter (gt = 1) as background, coalesce(sum(case when gt = 0 then unc_pct end), 0) as t from fx_vox v semi join s on s.case_id = v.case_id and s.z = v.z group by 1) select case_id, background, t::double / (100 * background)::double as unc from r")
def v13(spark, d):
    return V.slice_background(_vox(spark, d), 256)


@query("v14_suppress_uncertain", VOX + comp_sql("pred", 2, "p") + f", bad as (select c.case_id, comp from cc_p c join fx_vox v on v.case_id = c.case_id and v.x = c.x and v.y = c.y and v.z = c.z group by 1, 2 having avg(unc_pct) / 100 > 0.05::double), w as (select v.case_id, v.gt, case when b.comp is not null then 0 else v.pred end as pred from fx_vox v left join cc_p c on v.case_id = c.case_id and v.x = c.x and v.y = c.y and v.z = c.z left join bad b on b.case_id = c.case_id and b.comp = c.comp) select case_id, {CONF}, {GRID} - count(*) filter (gt = 1 or pred = 1) as tn from w group by 1")
def v14(spark, d):
    return V.confusion_counts(V.suppress_uncertain(_vox(spark, d), 0.05), GRID)


@query("v15_region_counts", REG + ", c as (select distinct case_id from fx_vox) select c.case_id, r.label, case when is_bone then 'Bone' when description like 'liver%' or description like 'lung%' then 'Organ' else 'Other' end as kind, description as name, count(v.case_id) as voxels from c cross join fx_regions r left join fx_vox v on v.case_id = c.case_id and v.ts = r.label group by 1, 2, 3, 4")
def v15(spark, d):
    return V.region_counts(_vox(spark, d), fixture(spark, d, "fx_regions"))


OVER = ", o as (select case_id, ts as label, count(*) as n, count(*) filter (gt = 1) as gt_voxels, count(*) filter (pred = 1) as pred_voxels, count(*) filter (gt = 1 and pred = 1) as both_voxels from fx_vox group by 1, 2), ov as (select *, gt_voxels * 1600::double as gt_mm3, pred_voxels * 1600::double as pred_mm3, both_voxels * 1600::double as both_mm3, round(gt_voxels * 100 / n, 2) as gt_percent, round(pred_voxels * 100 / n, 2) as pred_percent from o), fl as (select *, (label % 3 = 0 and gt_percent > 0) or gt_mm3 >= 4180 as hr_ground, ((label % 3 = 0 and pred_percent > 0) or pred_mm3 >= 4180) and both_mm3 >= 1 as hr_pred from ov)"


@query("v16_region_overlap", VOX + OVER + " select case_id, label, gt_voxels, pred_voxels, gt_mm3, pred_mm3, gt_percent, pred_percent from ov")
def v16(spark, d):
    return V.region_overlap(_vox(spark, d), MM3).drop("n", "both_voxels", "both_mm3")


@query("v17_region_intersection", VOX + OVER + " select case_id, label, both_mm3 from ov where both_voxels > 0")
def v17(spark, d):
    return V.region_overlap(_vox(spark, d), MM3).where("both_voxels > 0").select("case_id", "label", "both_mm3")


def _flags(spark, d):
    return V.high_risk_flags(V.region_overlap(_vox(spark, d), MM3), F.col("label") % 3 == 0)


@query("v18_high_risk_flags", VOX + OVER + " select case_id, label, hr_ground, hr_pred from fl")
def v18(spark, d):
    return _flags(spark, d).select("case_id", "label", "hr_ground", "hr_pred")


REGM = un_sql("pred", "gt", "p", True) + un_sql("gt", "pred", "g", True) + f", c as (select case_id, ts, {CONF} from fx_vox group by 1, 2), rm as (select c.case_id, c.ts, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as dice, coalesce(p.n_components, 0) as pred_lesions, coalesce(p.n_unmatched, 0) as fp_lesions, (coalesce(p.unmatched_voxels, 0) * 16 / 10)::double as fp_vol, coalesce(g.n_components, 0) as gt_lesions, coalesce(g.n_unmatched, 0) as fn_lesions, (coalesce(g.unmatched_voxels, 0) * 16 / 10)::double as fn_vol from c left join un_p p on p.case_id = c.case_id and p.ts = c.ts left join un_g g on g.case_id = c.case_id and g.ts = c.ts)"


@query("v19_region_metrics", VOX + REGM + " select * from rm")
def v19(spark, d):
    return _r(V.region_metrics(_vox(spark, d), VOXEL_ML), "dice", "fp_vol", "fn_vol")


@query("v20_merge_region_table", REG + OVER + REGM + ", k as (select distinct case_id from fx_vox) select k.case_id, r.label, r.description as name, coalesce(fl.n, 0) as voxels, coalesce(gt_mm3, 0) as gt_mm3, coalesce(pred_mm3, 0) as pred_mm3, coalesce(hr_ground, false) as hr_ground, coalesce(hr_pred, false) as hr_pred, coalesce(dice, 0) as dice, coalesce(fp_lesions, 0) as fp_lesions, coalesce(fn_lesions, 0) as fn_lesions from k cross join fx_regions r left join fl on fl.case_id = k.case_id and fl.label = r.label left join rm on rm.case_id = k.case_id and rm.ts = r.label")
def v20(spark, d):
    out = V.merge_region_table(_vox(spark, d), fixture(spark, d, "fx_regions"), MM3, VOXEL_ML, F.col("label") % 3 == 0)
    return _r(out, "dice").select("case_id", "label", "name", "voxels", "gt_mm3", "pred_mm3", "hr_ground", "hr_pred", "dice", "fp_lesions", "fn_lesions")


@query("v21_high_risk_sensitivity", REG + OVER + ", k as (select fl.*, unnest(list_filter(['All', case when is_bone then 'Bone' when description like 'liver%' or description like 'lung%' then 'Organ' end], lambda x: x is not null)) as kind from fl join fx_regions using (label)) select case_id, kind, round(coalesce(count(*) filter (hr_ground and hr_pred) / nullif(count(*) filter (hr_ground), 0), 0), 6) as sensitivity from k group by 1, 2")
def v21(spark, d):
    rows = _flags(spark, d).join(fixture(spark, d, "fx_regions"), "label")
    return _r(V.high_risk_sensitivity(rows, ["case_id"]), "sensitivity")


@query("v22_mask_region_overlap", REG + " select case_id, (count(*) filter (is_bone) * 16 / 10)::double as bone_ml, (count(*) filter (not is_bone) * 16 / 10)::double as organ_ml, round(count(*) filter (is_bone) * 100 / count(*), 6) as bone_percent from fx_vox join fx_regions on ts = label where pred = 1 group by 1")
def v22(spark, d):
    return _r(V.mask_region_overlap(_vox(spark, d), fixture(spark, d, "fx_regions"), VOXEL_ML), "bone_ml", "organ_ml", "bone_percent")


SIDE = lambda c: f"case when count(*) filter ({c}) > 0 then concat_ws('x', max(x + 1) filter ({c}), max(y + 1) filter ({c}), max(z + 1) filter ({c})) end"


@query("v23_compare_masks", VOX + f", m as (select case_id, x, y, z, case when case_id % 9 <> 0 then gt else 0 end as a, case when case_id % 7 <> 0 then pred else 0 end as b from fx_vox), o as (select case_id, count(*) filter (a = b) as same, count(*) filter (a <> b) as different, {SIDE('a = 1')} as shape_a, {SIDE('b = 1')} as shape_b from m where a = 1 or b = 1 group by 1) select *, case when shape_a is null or shape_b is null then 'missing' when different = 0 then 'equal' else 'different' end as status from o")
def v23(spark, d):
    v = _vox(spark, d)
    pick = lambda c, k: v.where(f"{c} = 1 and case_id % {k} <> 0").select("case_id", "x", "y", "z", F.col(c).alias("v"))
    return V.compare_masks(pick("gt", 9), pick("pred", 7))


@query("v24_crop", VOX + " select case_id, x - 2 as x, y - 3 as y, z - 1 as z, gt from fx_vox where x >= 2 and x < 10 and y >= 3 and y < 12 and z >= 1 and z < 5")
def v24(spark, d):
    v = _vox(spark, d).select("case_id", "x", "y", "z", "gt")
    boxes = v.select("case_id").distinct().selectExpr("case_id", "2 as x0", "10 as x1", "3 as y0", "12 as y1", "1 as z0", "5 as z1")
    return V.crop(v, boxes)


@query("v25_resample_nearest", VOX + ", ax as (select i as t, cast(floor(i * 15 / 7 + 0.5) as int) as s from range(8) t(i)), az as (select i as t, cast(floor(i * 6 / 3 + 0.5) as int) + 1 as s from range(4) t(i)) select case_id, cast(a.t as int) as x, cast(b.t as int) as y, cast(c.t as int) as z, ts from fx_vox v join ax a on a.s = v.x join ax b on b.s = v.y join az c on c.s = v.z")
def v25(spark, d):
    return V.resample_nearest(_vox(spark, d).select("case_id", "x", "y", "z", "ts"), SHAPE, (8, 8, 4), (0, 0, 1))


@query("v25_resample_linear", VOX + """, sh as (select distinct case_id, [16, 16, 7] as n, case case_id % 3 when 0 then [8, 8, 4] when 1 then [21, 16, 13] else [5, 1, 7] end as m from fx_vox),
ax as (select case_id, k, i, i * (n[k] - 1) // greatest(m[k] - 1, 1) as lo, i * (n[k] - 1) % greatest(m[k] - 1, 1) as r, greatest(m[k] - 1, 1) as d from sh, range(1, 4) a(k), range(21) b(i) where i < m[k]),
w as (select case_id, k, i, lo as s, d - r as w, d from ax union all select case_id, k, i, lo + 1, r, d from ax where r > 0)
select v.case_id, cast(a.i as int) as x, cast(b.i as int) as y, cast(c.i as int) as z, cast(sum(v.p1_pct * a.w * b.w * c.w) as double) / max(a.d * b.d * c.d) as p1, cast(sum(v.gt * a.w * b.w * c.w) as double) / max(a.d * b.d * c.d) as gt
from fx_vox v join w a on a.case_id = v.case_id and a.k = 1 and a.s = v.x join w b on b.case_id = v.case_id and b.k = 2 and b.s = v.y join w c on c.case_id = v.case_id and c.k = 3 and c.s = v.z - 1 group by 1, 2, 3, 4""")
def v25_linear(spark, d):
    v = _vox(spark, d).select("case_id", "x", "y", (F.col("z") - 1).alias("z"), F.col("p1_pct").alias("p1"), "gt")
    triple = lambda *n: F.array(*[F.lit(k) for k in n])
    target = F.when(F.col("case_id") % 3 == 0, triple(8, 8, 4)).when(F.col("case_id") % 3 == 1, triple(21, 16, 13)).otherwise(triple(5, 1, 7))
    shapes = v.select("case_id").distinct().select("case_id", triple(*SHAPE).alias("source"), target.alias("target"))
    return V.resample(v, shapes, ("p1", "gt"))


@query("v25_training_grid", VOX + """, bx as (select distinct case_id, case_id % 2 as z0, 6 + case_id % 2 as z1, 2 as y0, 12 + case_id % 5 as y1, case_id % 3 as x0, 16 as x1, [9 + case_id % 4, 11, 10] as m from fx_vox),
sh as (select *, [z1 - z0, y1 - y0, x1 - x0] as n from bx),
ax as (select case_id, k, i, cast(floor((2 * i * (n[k] - 1) + greatest(m[k] - 1, 1)) / (2 * greatest(m[k] - 1, 1))) as int) as s from sh, range(1, 4) a(k), range(12) b(i) where i < m[k])
select v.case_id, cast(a.i as int) as x, cast(b.i as int) as y, cast(c.i as int) as z, v.ts from fx_vox v join sh on sh.case_id = v.case_id and v.x >= x0 and v.x < x1 and v.y >= y0 and v.y < y1 and v.z - 1 >= z0 and v.z - 1 < z1
join ax a on a.case_id = v.case_id and a.k = 1 and a.s = v.z - 1 - z0 join ax b on b.case_id = v.case_id and b.k = 2 and b.s = v.y - y0 join ax c on c.case_id = v.case_id and c.k = 3 and c.s = v.x - x0""")
def v25_grid(spark, d):
    v = _vox(spark, d).select("case_id", "x", "y", (F.col("z") - 1).alias("z"), "ts")
    case = F.col("case_id").cast("int")
    cases = v.select("case_id").distinct()
    boxes = cases.select("case_id", (case % 2).alias("x0"), (case % 2 + 6).alias("x1"), F.lit(2).alias("y0"), (case % 5 + 12).alias("y1"), (case % 3).alias("z0"), F.lit(16).alias("z1"))
    return V.to_training_grid(v, boxes, cases.select("case_id", F.array(case % 4 + 9, F.lit(11), F.lit(10)).alias("target")), "ts")


@query("v26_permute_axes", VOX + " select case_id, z as x, y, x as z, gt from fx_vox")
def v26(spark, d):
    return V.permute_axes(_vox(spark, d), (2, 1, 0)).select("case_id", "x", "y", "z", "gt")


@query("v26_align_axes", VOX + " select case_id, case case_id % 4 when 0 then x when 1 then z when 2 then z end as x, case case_id % 4 when 0 then y when 1 then y when 2 then x end as y, case case_id % 4 when 0 then z when 1 then x when 2 then y end as z, gt from fx_vox")
def v26a(spark, d):
    v = _vox(spark, d).select("case_id", "x", "y", "z", "gt")
    triple = lambda *n: F.array(*[F.lit(k) for k in n])
    kind = F.col("case_id") % 4
    target = F.when(kind == 0, triple(16, 12, 7)).when(kind == 1, triple(7, 12, 16)).when(kind == 2, triple(7, 16, 12)).otherwise(triple(9, 9, 9))
    return V.align_axes(v, v.select("case_id", triple(16, 12, 7).alias("shape"), target.alias("target")).distinct())


@query("v27_uncertainty_summary", VOX + f""" select case_id, sum(unc_pct)::double / (100 * {GRID})::double as "all", sum(unc_pct) filter (unc_pct > 0)::double / nullif(100 * count(*) filter (unc_pct > 0), 0)::double as above_zero, sum(unc_pct) filter (pred = 1)::double / nullif(100 * count(*) filter (pred = 1), 0)::double as predicted, coalesce(sum(unc_pct) filter (pred = 0), 0)::double / (100 * ({GRID} - count(*) filter (pred = 1)))::double as non_predicted from fx_vox group by 1""")
def v27(spark, d):
    return V.uncertainty_summary(_vox(spark, d), GRID)


SAMPLES = ", s as (select case_id, x, y, z, (p1_pct * 5 + unc_pct * k) / 100 as p from fx_vox, (select unnest([1, 2, 3]) as k))"


def _samples(spark, d):
    return _vox(spark, d).select("case_id", "x", "y", "z", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), "p1_pct", "unc_pct").selectExpr("case_id", "x", "y", "z", "(p1_pct * 5 + unc_pct * k) / 100D as p")


H = "case when m > 0 and m < 1 then -(m * ln(m) + (1 - m) * ln(1 - m)) else 0 end"
SCALED = ", ".join(f"round({n}, 6) as {n}, round(({n} - min({n}) over ()) / nullif(max({n}) over () - min({n}) over (), 0), 6) as {n}_scaled" for n in ("aleatoric", "total", "epistemic"))


@query("v28_decompose_uncertainty", VOX + SAMPLES + f", m as (select case_id, x, y, z, avg(p) as m, avg(case when p > 0 and p < 1 then -(p * ln(p) + (1 - p) * ln(1 - p)) else 0 end) as aleatoric from s group by 1, 2, 3, 4), t as (select *, {H} as total, {H} - aleatoric as epistemic from m) select case_id, x, y, z, {SCALED} from t")
def v28(spark, d):
    out = V.decompose_uncertainty(_samples(spark, d))
    return _r(out, *[n for n, t in out.dtypes if t == "double"])


@query("v29_ensemble_mean", VOX + SAMPLES + " select case_id, x, y, z, round(avg(p), 6) as p, case when round(avg(p), 9) > 0.25 then 1 else 0 end as label from s group by 1, 2, 3, 4")
def v29(spark, d):
    return _r(V.ensemble_mean(_samples(spark, d).withColumn("p", F.round("p", 9)), 0.2500000001), "p")


@query("e1_project_volume", VOX + " select case_id, y, z, round(sum(p1_pct) / 16, 6) as mean_v, cast(max(p1_pct) as double) as max_v from fx_vox group by 1, 2, 3")
def e1(spark, d):
    v = _vox(spark, d)
    return V.project_volume(v, "p1_pct", "mean", SHAPE[0]).select("case_id", "y", "z", F.round("v", 6).alias("mean_v")).join(V.project_volume(v, "p1_pct", "max", SHAPE[0]).withColumnRenamed("v", "max_v"), ["case_id", "y", "z"])


@query("e2_scale_uint8", VOX + ", i as (select case_id, y, z, cast(max(p1_pct) as double) as v from fx_vox group by 1, 2, 3), e as (select case_id, min(v) as lo, max(v) as hi, avg(v) as mean, stddev_pop(v) as sd from i group by 1) select case_id, y, z, v, cast(case when hi > lo then floor((v - lo) / (hi - lo) * 255) end as int) as v8, cast(floor(v) as int) as plain, round(case when hi > lo then (v - mean) / sd end, 6) as z_score from i join e using (case_id)")
def e2(spark, d):
    images = V.project_volume(_vox(spark, d), "p1_pct", "max", SHAPE[0])
    out = V.scale_uint8(V.scale_uint8(images, "zscore").withColumn("z_score", F.round("v8", 6)).drop("v8"), "cast").withColumnRenamed("v8", "plain")
    return V.scale_uint8(out).select("case_id", "y", "z", "v", "v8", "plain", "z_score")
