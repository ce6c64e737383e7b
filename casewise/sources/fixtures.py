"""The library's input shapes as views over the driver's tables; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BODIES = {
    "fx_cases": """
select vec_id as case_id,
       case when label % 3 = 0 then 'PSMA' else 'FDG' end as tracer,
       concat(case when label % 3 = 0 then 'psma_' else 'fdg_' end, lpad(cast(vec_id as string), 8, '0'), '_0001.nii.gz') as filename,
       concat(case when label % 3 = 0 then 'psma_' else 'fdg_' end, lpad(cast(cast((vec_id - vec_id % 2) / 2 as bigint) as string), 8, '0')) as patient_id,
       vec_id % 10 = 0 as is_seed, embedding
from {embeddings}""",
    "fx_tokens": """
select cast((vec_id - vec_id % 10) / 10 as bigint) as case_id, cast(vec_id % 10 as int) as token_idx, embedding
from {embeddings}""",
    "fx_vox": """
select l_suppkey as case_id, cast(l_partkey % 16 as int) as x, cast(l_orderkey % 16 as int) as y, cast(l_linenumber as int) as z,
       max(case when l_quantity <= 12 then 1 else 0 end) as gt,
       max(case when l_quantity between 7 and 18 then 1 else 0 end) as pred,
       cast(1 + (cast((l_partkey % 16 - l_partkey % 4) / 4 as int) * 4 + cast((l_orderkey % 16 - l_orderkey % 4) / 4 as int)) * 7 + (l_linenumber - 1) as int) as ts,
       max(cast(round(l_discount * 100) as bigint)) as p1_pct, max(cast(round(l_tax * 100) as bigint)) as unc_pct
from {lineitem}
group by l_suppkey, l_partkey % 16, l_orderkey % 16, l_linenumber, l_partkey % 4, l_orderkey % 4""",
    "fx_regions": """
select distinct ts as label,
       case when ts = 5 then 'liver' when ts between 10 and 14 then concat('lung_', cast(ts as string)) else concat('region_', cast(ts as string)) end as description,
       (ts between 25 and 50 or ts between 69 and 78 or ts >= 91) as is_bone
from {fx_vox}""",
    "fx_case_metrics": """
select l_suppkey as case_name, cast(l_linenumber - 1 as int) as fold_num, concat('fold_', cast(l_linenumber - 1 as string)) as fold,
       case when l_suppkey % 3 = 0 then 'PSMA' else 'FDG' end as tracer, l_suppkey % 5 <> 0 as diseased,
       case when l_suppkey % 5 = 0 then 'NEGATIVE' when l_suppkey % 3 = 0 then 'PROSTATE_CANCER' when l_suppkey % 2 = 0 then 'LYMPHOMA' else 'LUNG_CANCER' end as diagnosis,
       case when l_suppkey % 5 = 0 then null else cast(sum(cast(round(l_discount * 100) as bigint)) as double) / cast(count(*) * 10 as double) end as dice,
       cast(sum(cast(l_quantity as bigint)) as double) / cast(count(*) as double) as false_pos_vol,
       case when l_suppkey % 5 = 0 then null else cast(sum(cast(round(l_tax * 100) as bigint)) as double) / cast(count(*) as double) end as false_neg_vol,
       case when l_suppkey % 5 = 0 then 0 else count(distinct l_partkey % 16) end as num_gt_lesions,
       count(distinct l_orderkey % 16) as num_pred_lesions,
       case when l_suppkey % 5 = 0 then 0 else count(distinct case when l_quantity > 48 then l_partkey % 16 end) end as false_missed_lesions,
       count(distinct case when l_quantity > 47 then l_orderkey % 16 end) as false_detected_lesions
from {lineitem} group by l_suppkey, l_linenumber""",
    "fx_splits": """
select s.split_id, 'train' as role, c.case_id, c.tracer, c.filename
from {fx_cases} c join (select distinct cast(label as int) as split_id from {embeddings} where label < 4) s on c.case_id % (10 - 2 * s.split_id) = 0
union all
select s.split_id, 'val' as role, c.case_id, c.tracer, c.filename
from {fx_cases} c join (select distinct cast(label as int) as split_id from {embeddings} where label < 4) s on c.case_id % 10 = 9""",
    "fx_uncertainty": """
select user_id as case_id, case when event_id % 2 = 0 then 'm1' else 'm2' end as method,
       cast(sum(cast(round(value * 100) as bigint)) as double) / cast(count(*) as double) as average_uncertainty,
       cast(sum(case when event_type = 'click' then cast(round(value * 100) as bigint) else 0 end) as double) / cast(count(*) as double) as average_uncertainty_predicted,
       cast(count(case when event_type = 'purchase' then 1 end) as double) / cast(count(*) as double) as dice
from {events} group by user_id, case when event_id % 2 = 0 then 'm1' else 'm2' end""",
}
#: mm; grid extent of every fixture case.
SPACING = (4.0, 4.0, 100.0)
VOXEL_ML = 1.6
SHAPE = (16, 16, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a driver table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    body = BODIES[name]
    needs = {n: fixture(spark, sf_dir, n) for n in (*TABLES, *BODIES) if "{" + n + "}" in body}
    return spark.sql(body, **needs)


def ctes(*names: str) -> str:
    """The fixtures, with those they need, as the head of a DuckDB query."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in BODIES:
            if "{" + m + "}" in BODIES[n]:
                add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    plain = {n: n for n in (*TABLES, *BODIES)}
    return "with recursive " + ",\n".join(f"{n} as ({BODIES[n].format(**plain)})" for n in order)
