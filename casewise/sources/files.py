"""Readers and writers of split files, metric files, logs and listings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "array<struct<train:array<string>,val:array<string>>>"
#: Paths that `scratch` gave out.
WRITTEN: list[str] = []
SUMMARY = "foreground_mean map<string,double>, metric_per_case array<struct<prediction_file:string,metrics:map<string,struct<TP:long,FP:long,FN:long,Dice:double>>>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir; in local mode in a folder of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Deletes the paths that this driver has taken in the shared folder so far; returns how many there were.

    For a caller that has written its results: DataFrames returned earlier read
    from these paths and are of no use afterwards.
    """
    found = 0
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        found += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def write_splits(splits: DataFrame, path: str) -> None:
    """Long rows (split_id, role, pos, case) as a JSON list of {train, val} in order of split and position; split_id counts from 0.

    A split file names each case of a few splits once; it is one document by
    its format.
    """
    names = F.array_sort(F.collect_list(F.struct("pos", "case")))
    per = splits.groupBy("split_id", "role").agg(F.transform(names, lambda x: x["case"]).alias("cases"))
    pick = lambda r: F.coalesce(F.first(F.when(F.col("role") == r, F.col("cases")), ignorenulls=True), F.array().cast("array<string>"))
    one = per.groupBy("split_id").agg(F.struct(pick("train").alias("train"), pick("val").alias("val")).alias("s"))
    whole = one.agg(F.array_sort(F.collect_list(F.struct("split_id", "s"))).alias("a")).select(F.to_json(F.transform("a", lambda x: x["s"])).alias("value"))
    whole.write.text(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """split_id, role, pos, case; entries of the list that are no objects (gap fillers) are skipped, keeping their place."""
    parsed = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("split_id", "s"))
    item = parsed.select("split_id", F.from_json("s", "struct<train:array<string>,val:array<string>>").alias("s"))
    rows = item.select("split_id", F.explode(F.create_map(F.lit("train"), F.col("s.train"), F.lit("val"), F.col("s.val"))).alias("role", "cases"))
    return rows.select("split_id", "role", F.posexplode("cases").alias("pos", "case"))


def write_split_parts(splits: DataFrame, path: str, block: int = 10_000) -> None:
    """Long rows (split_id, role, pos, case) as JSON lines in a folder for each split: split_id=<n>/, lines of role, first place and up to `block` cases in order.

    The form for splits of any size: no row holds more than a block, and a reader
    of one split opens its folder only. The one document of `write_splits` stays
    for readers that ask for it.
    """
    first = (F.floor(F.col("pos") / block) * block).cast("long").alias("first")
    places = F.array_sort(F.collect_list(F.struct("pos", "case")))
    lines = splits.groupBy("split_id", "role", first).agg(places.alias("p"))
    lines.select("split_id", "role", F.transform("p", lambda x: x["pos"] - F.col("first")).alias("places"), "first", F.transform("p", lambda x: x["case"]).alias("cases")).write.partitionBy("split_id").option("ignoreNullFields", False).json(path)


def read_split_parts(spark: SparkSession, path: str) -> DataFrame:
    """split_id, role, pos, case from the folders of `write_split_parts`, as `read_splits` gives them; gaps between places are kept."""
    rows = spark.read.schema("role string, places array<int>, first long, cases array<string>, split_id int").json(path)
    each = rows.select("split_id", "role", "first", F.explode(F.arrays_zip("places", "cases")).alias("c"))
    return each.select("split_id", "role", (F.col("first") + F.col("c.places")).cast("int").alias("pos"), F.col("c.cases").alias("case"))


def parse_summaries(text: Column) -> Column:
    """Model summary JSON as a struct; NaN becomes null on use."""
    return F.from_json(text, f"struct<{SUMMARY.replace(' map', ':map').replace(' array', ':array').replace(', metric', ',metric')}>", {"allowNonNumericNumbers": "true"})


def read_summaries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """dataset, split, fold, case, tp, fp, fn, dice of label "1", foreground_dice of the file, from summary.json files.

    Data set (Dataset<n>), split (a folder validation or test) and fold (fold_<n>) are in
    the path, null where it does not say. `lines` reads files with one summary
    a line; otherwise a file is one summary.
    """
    rows = spark.read.option("multiLine", not lines).option("allowNonNumericNumbers", True).schema(SUMMARY).json(path).select("*", "_metadata.file_path")
    place = lambda pattern: F.nullif(F.regexp_extract("file_path", pattern, 1), F.lit(""))
    where = [place(r"Dataset(\d+)").cast("int").alias("dataset"), place(r"/(validation|test)/").alias("split"), place(r"fold_(\d+)").cast("int").alias("fold")]
    whole = F.element_at("foreground_mean", F.lit("Dice"))
    rows = rows.select(*where, F.nanvl(whole, F.lit(None)).alias("foreground_dice"), F.explode("metric_per_case").alias("m"))
    one = F.element_at("m.metrics", F.lit("1"))
    return rows.select("dataset", "split", "fold", strip_extension(F.substring_index("m.prediction_file", "/", -1)).alias("case"), one["TP"].alias("tp"), one["FP"].alias("fp"), one["FN"].alias("fn"), F.nanvl(one["Dice"], F.lit(None)).alias("dice"), "foreground_dice")


def read_lesion_metrics(spark: SparkSession, path: str, schema: str, name: str = "case_name") -> DataFrame:
    """Per-file lesion CSVs, the case name without its file suffix."""
    return read_case_csvs(spark, path, schema).withColumn(name, strip_extension(F.col(name)))


def read_diagnosis(spark: SparkSession, path: str, location: str = "file_location", diagnosis: str = "diagnosis") -> DataFrame:
    """case_key, diagnosis from a metadata CSV; rows of one key with the same diagnosis count once."""
    rows = spark.read.option("header", True).schema(f"`{location}` string, `{diagnosis}` string").csv(path)
    return rows.select(diagnosis_key(F.col(location)).alias("case_key"), F.col(diagnosis).alias("diagnosis")).dropDuplicates()


def write_results(df: DataFrame, path: str, by: list[str]) -> None:
    """CSV by the given partition columns; nothing is written for an empty result."""
    if not df.isEmpty():
        df.write.partitionBy(*by).option("header", True).csv(path)


def read_case_csvs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.nii\.gz$", "")


def diagnosis_key(location: Column) -> Column:
    """`fdg_<pid>_<scan>` from a location .../PETCT_<pid>/<scan>/..."""
    parts = F.split(location, "/")
    return F.concat(F.lit("fdg_"), F.regexp_replace(F.get(parts, F.lit(2)), "^PETCT_", ""), F.lit("_"), F.get(parts, F.lit(3)))


def read_region_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).schema("label int, description string, is_bone boolean").csv(path)


def case_inventory(labels: DataFrame, listings: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Per label case the smallest path of each listing whose file name contains the case's key, and the names of the listings that lack it.

    labels: case_id, name; listings: path. The key is what the pattern's group
    finds in the last part of a name or path, so "contained in" is an equi-join;
    names without a key match nothing.
    """
    key = lambda c: F.nullif(F.regexp_extract(F.substring_index(F.lower(c), "/", -1), pattern, 1), F.lit(""))
    out = labels.select("case_id", key("name").alias("_key")).distinct()
    for name, rows in listings.items():
        out = out.join(rows.select(key("path").alias("_key"), "path").groupBy("_key").agg(F.min("path").alias(name)), "_key", "left")
    return out.drop("_key").withColumn("missing", F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in listings])))


def extract_log_metric(logs: DataFrame, pattern: str) -> DataFrame:
    """name, value: the first number that the pattern's group finds in each log text; logs without one are left out."""
    rows = logs.select("name", F.regexp_extract("text", pattern, 1).alias("v")).where("v <> ''")
    return rows.select("name", F.col("v").cast("long").alias("value"))


def case_metrics_json(df: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """case_id, json: per case the figures of both methods and their absolute differences, nested; six digits. Rows: case_id, method and the columns."""
    digits = lambda c: F.round(c, 6).cast("decimal(18,6)")
    side = lambda m: df.where(F.col("method") == m).select("case_id", *[F.col(c).alias(f"{c}_{m}") for c in columns])
    both = side(a).join(side(b), "case_id")
    parts = [F.struct(*[digits(F.col(f"{c}_{m}")).alias(c) for c in columns]).alias(m) for m in (a, b)]
    gaps = F.struct(*[digits(F.abs(F.col(f"{c}_{a}") - F.col(f"{c}_{b}"))).alias(c) for c in columns]).alias("difference")
    return both.select("case_id", F.to_json(F.struct(*parts, gaps)).alias("json"))
