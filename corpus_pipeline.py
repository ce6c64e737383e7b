"""A corpus pipeline: toxicity, near duplicates, repeated strings, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; run() writes each result as Parquet to the shared folder and reads it
for the next one. All stages but the last return the columns of documents.

Defined results: null and empty texts pass every stage (they are no one's near
duplicate) and end as the end id alone; of rows with equal doc_id and text one
stays, and texts that share a doc_id are judged each on its own; a null doc_id
counts as the greatest; ties of near duplicates go to the least doc_id; texts of
any length are treated whole; further columns are dropped; an empty table gives
no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm import jaccard, packing, repeats, secrets, toxicity
from casewise.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    scored = toxicity.score(rows.select(F.col("_row").alias("doc_id"), "text"), model).where("predicted = 1").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(scored, "_row", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays, one with the least doc_id; rows are told apart by id and text."""
    marks = [F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_b")]
    rows = docs.select(*COLUMNS, *marks)
    found = jaccard.near_duplicates(rows, carry=("_a", "_b"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_a", "_b")).alias("best")
    stay = found.groupBy("component").agg(best).select("best._a", "best._b")
    return rows.join(stay, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut; characters cut through go whole, texts left empty stay."""
    cut = repeats.remove_repeats(docs, carry=("lang", "source"))
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    rows = secrets.fit_and_scan(docs, F.col("source"))
    return rows.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token pieces in sequences of 2048."""
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("secrets", redact_secrets), ("packing", pack)]
#: Classifiers, MinHash and tokenizers have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
