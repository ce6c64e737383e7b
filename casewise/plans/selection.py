"""Registered queries on embeddings, splits and names, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.functions.names import case_key, tracer_of
from casewise.operators import selection as S
from casewise.operators import splits as X
from casewise.operators.ordering import quantile_group
from casewise.sources.fixtures import ctes, fixture

CASES = ctes("fx_cases")
DIST = CASES + """, pool as (select * from fx_cases where not is_seed), seed as (select * from fx_cases where is_seed),
dist as (select p.case_id, p.tracer, coalesce(min(list_cosine_distance(p.embedding::double[], s.embedding::double[])), 0) as d from pool p left join seed s on s.tracer = p.tracer group by p.case_id, p.tracer)
"""


def _pool(spark, d):
    return fixture(spark, d, "fx_cases").where("not is_seed")


def _seed(spark, d):
    return fixture(spark, d, "fx_cases").where("is_seed")


def _dist(spark, d):
    return S.min_distance_to_labelled(_pool(spark, d), _seed(spark, d))


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _splits(spark, d):
    return fixture(spark, d, "fx_splits")


def _train(spark, d, k):
    return _splits(spark, d).where(f"role = 'train' and split_id = {k}")


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p1_tracer_of", CASES + """ select case_id, case when contains(lower(filename), 'fdg_') then 'FDG' when contains(lower(filename), 'psma_') then 'PSMA' else 'Unknown' end as by_substring,
case when lower(filename) like 'fdg%' then 'FDG' when lower(filename) like 'psma%' then 'PSMA' end as by_prefix,
case when lower(filename) like '%target%' then 'PSMA' when lower(filename) like '%fdg%' then 'FDG' else 'PSMA' end as by_default from fx_cases""")
def p1(spark, d):
    f = F.col("filename")
    return fixture(spark, d, "fx_cases").select("case_id", tracer_of(f).alias("by_substring"), tracer_of(f, "prefix").alias("by_prefix"), tracer_of(f, "default_psma").alias("by_default"))


@query("p2_case_key", CASES + " select case_id, regexp_replace(split_part(filename, '.', 1), '(_000[01]|_total_uncertainty)$', '') as k from fx_cases")
def p2(spark, d):
    return fixture(spark, d, "fx_cases").select("case_id", case_key(F.concat(F.lit("/data/"), "filename")).alias("k"))


@query("s8_read_embeddings", CASES + " select replace(filename, '_0001.nii.gz', '') as k, len(embedding) as dims from fx_cases")
def s8(spark, d):
    return fixture(spark, d, "fx_cases").select(F.regexp_replace("filename", r"_0001\.nii\.gz$", "").alias("k"), F.size("embedding").cast("long").alias("dims"))


@query("j1_unlabelled", ctes("fx_cases", "fx_splits") + " select case_id, tracer from fx_cases where case_id not in (select case_id from fx_splits where role = 'train' and split_id = 0)")
def j1(spark, d):
    return S.unlabelled(fixture(spark, d, "fx_cases"), _train(spark, d, 0)).select("case_id", "tracer")


@query("j2_labelled", ctes("fx_cases", "fx_splits") + " select case_id, tracer from fx_cases where case_id in (select case_id from fx_splits where role = 'train' and split_id = 0)")
def j2(spark, d):
    return S.labelled(fixture(spark, d, "fx_cases"), _train(spark, d, 0)).select("case_id", "tracer")


@query("e5_min_distance", DIST + " select case_id, tracer, round(d, 6) as dist_to_labelled from dist")
def e5(spark, d):
    return _r(_dist(spark, d), "dist_to_labelled")


PAIRS = " select tracer, 'closest' as kind, a as case_a, b as case_b, round(d, 6) as distance from (select *, row_number() over (partition by tracer order by round(d, 9), a, b) as r from p) where r = 1 union all select tracer, 'furthest', a, b, round(d, 6) from (select *, row_number() over (partition by tracer order by round(d, 9) desc, a, b) as r from p) where r = 1"


@query("e6_pairwise_extremes", CASES + ", p as (select x.tracer, x.case_id as a, y.case_id as b, list_cosine_distance(x.embedding::double[], y.embedding::double[]) as d from fx_cases x join fx_cases y on x.tracer = y.tracer and x.case_id < y.case_id)" + PAIRS)
def e6(spark, d):
    return _r(S.extremes(fixture(spark, d, "fx_cases")), "distance").drop("compared")


@query("e7_cross_extremes", CASES + ", p as (select x.tracer, x.case_id as a, y.case_id as b, list_cosine_distance(x.embedding::double[], y.embedding::double[]) as d from fx_cases x join fx_cases y on x.tracer = y.tracer and not x.is_seed and y.is_seed)" + PAIRS)
def e7(spark, d):
    return _r(S.extremes(_pool(spark, d), _seed(spark, d)), "distance").drop("compared")


@query("e8_distance_table", DIST + " select case_id, tracer, round(d, 6) as dist_to_labelled, cast(row_number() over (partition by tracer order by case_id) - 1 as int) as index from dist")
def e8(spark, d):
    return _r(S.distance_table(_dist(spark, d), _pool(spark, d)), "dist_to_labelled")


@query("e9_top_percent", DIST + " select case_id, tracer, round(d, 6) as dist_to_labelled from (select *, row_number() over (order by d desc, case_id) as r, count(*) over () as n from dist) where r <= greatest(1, ceil(n * 5 / 100))")
def e9(spark, d):
    return _r(S.top_percent(_dist(spark, d), 0.05), "dist_to_labelled")


BY_TRACER = "select case_id, tracer, d from (select *, row_number() over (partition by tracer order by d desc, case_id) as r, count(*) over (partition by tracer) as n from dist) where r <= greatest(1, ceil(n * 5 / 100))"


@query("e10_top_percent_by_tracer", DIST + " select case_id, tracer, round(d, 6) as dist_to_labelled from (" + BY_TRACER + ")")
def e10(spark, d):
    return _r(S.top_percent_by_tracer(_dist(spark, d), 0.05), "dist_to_labelled")


@query("e11_top_percent_totals", DIST + " select case_id, tracer, round(d, 6) as dist_to_labelled from (select *, row_number() over (partition by tracer order by d desc, case_id) as r from dist) where r <= ceil(case tracer when 'PSMA' then 379 else 664 end * 5 / 100)")
def e11(spark, d):
    return _r(S.top_percent_by_tracer(_dist(spark, d), 0.05, {"PSMA": 379, "FDG": 664}), "dist_to_labelled")


@query("e12_rank_by_diversity", DIST + ", top as (" + BY_TRACER + "), t as (select c.case_id, c.tracer, c.embedding::double[] as e from top join fx_cases c using (case_id)), m as (select x.case_id, x.tracer, case when count(*) > 1 then sum(case when x.case_id = y.case_id then 0 else list_cosine_distance(x.e, y.e) end) / count(*) end as a from t x join t y using (tracer) group by x.case_id, x.tracer) select case_id, tracer, round(a, 6) as avg_dist_to_top_subset, cast(row_number() over (partition by tracer order by round(a, 9) desc, case_id) as int) as diversity_rank from m")
def e12(spark, d):
    top = S.top_percent_by_tracer(_dist(spark, d), 0.05).select("case_id")
    return _r(S.rank_by_diversity(fixture(spark, d, "fx_cases").join(top, "case_id")), "avg_dist_to_top_subset").select("case_id", "tracer", "avg_dist_to_top_subset", "diversity_rank")


@query("e13_worst_covered", DIST + " select case_id, tracer, round(d, 6) as dist_to_labelled, cast(r as int) as place from (select *, row_number() over (partition by tracer order by d desc, case_id) as r from dist) where r <= 5")
def e13(spark, d):
    return _r(S.worst_covered(_dist(spark, d)), "dist_to_labelled")


@query("e3_pool_tokens", ctes("fx_tokens") + ", t as (select case_id, token_idx, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) - 1 as dim from fx_tokens) select case_id, cast(dim as int) as dim, round(max(case when token_idx = 0 then v end), 6) as cls, round(avg(case when token_idx > 0 then v end), 6) as patch_mean, round(stddev_pop(case when token_idx > 0 then v end), 6) as patch_std from t group by case_id, dim")
def e3(spark, d):
    pooled = S.pool_tokens(fixture(spark, d, "fx_tokens"))
    rows = pooled.select("case_id", F.posexplode(F.arrays_zip("cls", "patch_mean", "patch_std")).alias("dim", "t"))
    return _r(rows.select("case_id", "dim", "t.cls", "t.patch_mean", "t.patch_std"), "cls", "patch_mean", "patch_std")


@query("e4_embedding_metadata", CASES + ", t as (select case_id, case_id % 8 as batch, unnest(embedding::double[]) as v from fx_cases), m as (select case_id, batch, min(v * 255) as low, max(v * 255) as high, avg(v) as mean, stddev_pop(v) as std from t group by 1, 2) select case_id, batch, round(low, 6) as low, round(high, 6) as high, round(mean, 6) as mean, round(std, 6) as std, round(avg(mean) over (partition by batch), 6) as batch_mean, round(avg(std) over (partition by batch), 6) as batch_std from m")
def e4(spark, d):
    image = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 255)
    cases = fixture(spark, d, "fx_cases").withColumns({"image": image, "batch": F.col("case_id") % 8})
    return _r(S.embedding_metadata(cases, "batch"), "low", "high", "mean", "std", "batch_mean", "batch_std")


@query("e14_kernel_pca")
def e14(spark, d):
    return S.cosine_kernel_pca(_seed(spark, d), fixture(spark, d, "fx_cases"))


@query("e15_dpp_greedy")
def e15(spark, d):
    return S.dpp_greedy(_pool(spark, d), 6)


@query("e16_dpp_quality")
def e16(spark, d):
    return S.dpp_greedy(_pool(spark, d).withColumn("q", 1 + F.col("case_id") % 5), 4, "q")


@query("e17_kmeans")
def e17(spark, d):
    return S.kmeans_clusters(fixture(spark, d, "fx_cases"), 4)


@query("e18_distance_histogram", DIST + ", e as (select tracer, min(d) as lo, max(d) as hi from dist group by tracer) select tracer, cast(least(floor((d - lo) / (hi - lo) * 20), 19) as int) as bin, count(*) as n from dist join e using (tracer) group by 1, 2")
def e18(spark, d):
    return S.distance_histogram(_dist(spark, d), 20, ["tracer"])


@query("e19_attach_uncertainty", ctes("fx_cases", "fx_uncertainty") + " select c.case_id, c.tracer, round(u.average_uncertainty_predicted, 6) as u from fx_cases c left join fx_uncertainty u on c.case_id = u.case_id and u.method = 'm1' where not c.is_seed")
def e19(spark, d):
    u = fixture(spark, d, "fx_uncertainty").where("method = 'm1'").select("case_id", F.round("average_uncertainty_predicted", 6).alias("u"))
    return _pool(spark, d).select("case_id", "tracer").join(u, "case_id", "left")


PCT = "(select unnest([1, 5, 10, 20]) as percent)"


@query("x1_prefix_splits", CASES + f", r as (select case_id, tracer, row_number() over (partition by tracer order by case_id) as rn, count(*) over (partition by tracer) as n from fx_cases) select percent, tracer, case_id from r, {PCT} where rn * 100 <= n * percent")
def x1(spark, d):
    return X.prefix_splits(fixture(spark, d, "fx_cases"), [1, 5, 10, 20])


@query("x2_selection_splits", DIST + f", r as (select case_id, tracer, row_number() over (partition by tracer order by d desc, case_id) as rn, count(*) over (partition by tracer) as n from dist) select percent, case_id from r, {PCT} where rn <= greatest(1, ceil(n * percent / 100)) union select percent, case_id from seed, {PCT}")
def x2(spark, d):
    return X.selection_splits(_seed(spark, d), _dist(spark, d), [1, 5, 10, 20])


@query("x3_dpp_splits")
def x3(spark, d):
    every, seed, counts = fixture(spark, d, "fx_cases"), _seed(spark, d), [2, 4, 6]
    added = X.dpp_splits(S.dpp_greedy(_pool(spark, d), 6), seed, counts).withColumn("form", F.lit("added"))
    return added.union(X.dpp_splits(S.dpp_greedy(every, 6), seed.where("false"), counts).withColumn("form", F.lit("fresh")))


@query("x4_random_splits", ctes("fx_cases", "fx_splits") + ", sd as (select unnest([42, 43, 44, 45]) as s), p as (select case_id, tracer, s, row_number() over (partition by s, tracer order by md5(s::varchar || ':' || case_id::varchar), case_id) as rn from fx_cases, sd where not is_seed), n as (select tracer, count(*) as n from fx_cases where is_seed group by tracer) select s as seed, tracer, case_id from p join n using (tracer) where rn <= n union select s, tracer, case_id from fx_cases, sd where is_seed union select 0, tracer, case_id from fx_splits where role = 'train' and split_id = 1")
def x4(spark, d):
    seed = _seed(spark, d)
    return X.random_splits(_pool(spark, d), seed.groupBy("tracer").agg(F.count("*").alias("n")), [42, 43, 44, 45], seed, _train(spark, d, 1))


SCORED = ", sc as (select case_id, sum(average_uncertainty) as score from fx_uncertainty group by case_id)"


def _scored(spark, d):
    return fixture(spark, d, "fx_uncertainty").groupBy("case_id").agg(F.sum("average_uncertainty").alias("score"))


@query("x5_quartile_splits", ctes("fx_cases", "fx_uncertainty") + SCORED + ", q as (select case_id, ntile(4) over (order by round(score, 6), case_id) as q from sc) select step, case_id from q, (select unnest([0, 1, 2, 3, 4]) as step) where q <= step union select step, case_id from fx_cases, (select unnest([0, 1, 2, 3, 4]) as step) where is_seed")
def x5(spark, d):
    return X.quartile_splits(_seed(spark, d), _r(_scored(spark, d), "score"))


@query("w3_quartile", ctes("fx_uncertainty") + SCORED + " select case_id, cast(ntile(4) over (order by round(score, 6), case_id) as int) as q from sc")
def w3(spark, d):
    return quantile_group(_r(_scored(spark, d), "score"), "score", ["case_id"], 4, "q").select("case_id", "q")


SPL = ctes("fx_cases", "fx_splits")


@query("x6_overlap_matrix", SPL + ", t as (select distinct split_id, case_id from fx_splits where role = 'train'), i as (select distinct split_id from t) select a.split_id as i, b.split_id as j, count(y.case_id) as n from i a cross join i b left join t x on x.split_id = a.split_id left join t y on y.split_id = b.split_id and y.case_id = x.case_id group by 1, 2")
def x6(spark, d):
    return X.overlap_matrix(_splits(spark, d))


@query("x7_common_to_all", SPL + " select case_id from fx_splits where role = 'train' group by case_id having count(distinct split_id) = (select count(distinct split_id) from fx_splits where role = 'train')")
def x7(spark, d):
    return X.common_to_all(_splits(spark, d))


@query("x7_intersection_sizes", ctes("fx_cases", "fx_splits") + DIST[len(CASES):] + ", ch as (" + BY_TRACER + "), tr as (select distinct split_id, case_id from fx_splits where role = 'train') select split_id, count(ch.case_id) as n from tr left join ch using (case_id) group by 1 union all select null, count(*) from (select case_id from tr group by 1 having count(*) = (select count(distinct split_id) from tr))")
def x7i(spark, d):
    return X.intersection_sizes(_splits(spark, d), S.top_percent_by_tracer(_dist(spark, d), 0.05))


@query("x8_all_minus_train", SPL + " select case_id from fx_cases except select case_id from fx_splits where role = 'train' and split_id = 1")
def x8(spark, d):
    return S.unlabelled(fixture(spark, d, "fx_cases"), _train(spark, d, 1)).select("case_id")


@query("x9_label_manifest", SPL + ", l as (select case_id from fx_cases where case_id % 7 <> 0), dn as (select case_id from fx_cases where case_id % 5 = 0), h as (select case_id, 'hard' as source from fx_splits where role = 'train' and split_id = 0 union select case_id, 'validation' from fx_splits where role = 'val' and split_id = 0), m as (select * from h union select case_id, 'pseudo' from fx_cases where case_id not in (select case_id from h)) select case_id, source, case when case_id not in (select case_id from l) then 'MISSING' when case_id in (select case_id from dn) then 'EXISTS' else 'OK' end as status from m")
def x9(spark, d):
    c = fixture(spark, d, "fx_cases")
    return X.label_manifest(_train(spark, d, 0), _splits(spark, d).where("role = 'val' and split_id = 0"), c, c.where("case_id % 7 <> 0"), c.where("case_id % 5 = 0"))


@query("x10_check_leakage", SPL + " select split_id, patient_id, count(distinct s.case_id) as n_cases from fx_splits s join fx_cases c using (case_id) group by 1, 2 having count(distinct role) > 1")
def x10(spark, d):
    return X.check_leakage(_splits(spark, d), fixture(spark, d, "fx_cases"))


@query("x11_compare_splits", SPL + ", p as (select split_id, role, row_number() over (partition by split_id, role order by case_id) as pos, case_id from fx_splits), a as (select * from p where role = 'train'), b as (select * from p where role = 'val') select coalesce(a.split_id, b.split_id) as split_id, count(*) filter (a.case_id is not distinct from b.case_id) as n_same, count(*) filter (a.case_id is distinct from b.case_id) as n_different from a full join b on a.split_id = b.split_id and a.pos = b.pos group by 1")
def x11(spark, d):
    from pyspark.sql import Window

    p = _splits(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("split_id", "role").orderBy("case_id")))
    return X.compare_splits(p.where("role = 'train'"), p.where("role = 'val'"))


@query("x12_tracer_counts", SPL + """ select split_id, role, count(*) filter (tracer = 'FDG') as "FDG", count(*) filter (tracer = 'PSMA') as "PSMA" from fx_splits group by 1, 2""")
def x12(spark, d):
    return X.tracer_counts(_splits(spark, d))
