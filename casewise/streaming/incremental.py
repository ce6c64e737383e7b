"""Pending cases, and case metrics computed as voxel files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casewise.operators.voxels import case_metrics
from casewise.sources.files import stored

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pending_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases that have no result yet."""
    return cases.join(results.select("case_id").distinct(), "case_id", "left_anti")


def tally(cases: DataFrame, results: DataFrame) -> DataFrame:
    """status, n: ok or error by the results, missing where there is none."""
    rows = cases.select("case_id").distinct().join(results.select("case_id", "status"), "case_id", "left")
    return rows.groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def stream_case_metrics(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, voxel_ml: float, grid: int, files_per_batch: int = 100) -> None:
    """Evaluates what has arrived in a folder of voxel Parquet files and returns; a later call goes on from the checkpoint.

    A case arrives whole in one file. A batch is written under its number, so
    one that runs again replaces its rows.
    """

    def evaluate(batch: DataFrame, number: int) -> None:
        case_metrics(batch, batch, voxel_ml, grid).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    rows.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What waits for a case: its parts, the voxels of each as whole numbers, and when the wait is over (ms).
WAITING = "part array<int>, voxels array<binary>, until long"
COLUMNS = ["x", "y", "z", "gt", "pred"]
#: Stands for null in packed voxels.
NOTHING = -(1 << 31)


def _packed(rows: np.ndarray) -> bytes:
    """The different rows of a part."""
    rows = np.ascontiguousarray(rows, np.int32)
    return np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1])))).tobytes()


def whole_cases(wait_ms: int):
    """A function of (key, pandas frames, state) that gathers the parts of a case and gives them out once all are there, or once wait_ms have passed since the first.

    Rows: case_id, part (from 0), parts (how many the case has), x, y, z, gt,
    pred; out: the voxels and `whole`. A part comes whole in one file; one that
    comes again counts once. A part without voxels is one row with x null. Parts
    that come after their case was given up begin it anew. State goes to the
    worker and back with the rows of many cases, not by a call for each.
    """

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part, voxels, until = state.get if state.exists else ([], [], None)
        held = dict(zip(part, map(bytes, voxels), strict=True))
        if state.hasTimedOut:
            state.remove()
            yield out(key, held, False)
            return
        came = pd.concat(list(frames))
        parts, rows = came["part"].to_numpy(), came[COLUMNS].to_numpy("float64", na_value=np.nan)
        rows = np.where(np.isnan(rows), NOTHING, rows).astype(np.int32)
        for p in np.unique(parts).tolist():
            if p not in held:
                held[p] = _packed(rows[parts == p])
        now = state.getCurrentProcessingTimeMs()
        until, all_there = until or now + wait_ms, len(held) >= came["parts"].max()
        if all_there or (state.exists and until <= now):
            if state.exists:
                state.remove()
            yield out(key, held, bool(all_there))
        else:
            state.update((list(held), list(held.values()), until))
            state.setTimeoutDuration(max(1, until - now))

    def out(key: tuple, held: dict[int, bytes], whole: bool) -> pd.DataFrame:
        found = np.frombuffer(b"".join(held.values()), np.int32).reshape(-1, len(COLUMNS))
        there = found[:, 0] != NOTHING
        found = (found[there] if there.any() else found[:1]).astype(np.float64)
        found[found == NOTHING] = np.nan
        return pd.DataFrame(found, columns=COLUMNS).assign(case_id=key[0], whole=whole)[["case_id", *COLUMNS, "whole"]]

    return gather


def stream_split_cases(spark: SparkSession, folder: str, out: str, checkpoint: str, case_type: str, voxel_ml: float, grid: int, wait_ms: int = 86_400_000, files_per_batch: int = 100) -> None:
    """Evaluates cases that arrive in several files, in any order and over several runs, and returns when what has arrived is read; a later call goes on from the checkpoint.

    Files: case_id, part, parts, x, y, z, gt, pred as Parquet. Parts wait in the
    checkpoint's state store, by case. Results are those of case_metrics with a
    status, ok or incomplete (the wait was over, which is looked at whenever files
    arrive), one row per case and batch.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers ask for batches without end
    schema = f"case_id {case_type}, part int, parts int, x int, y int, z int, gt int, pred int"
    shown = f"case_id {case_type}, x int, y int, z int, gt int, pred int, whole boolean"

    def evaluate(batch: DataFrame, number: int) -> None:
        batch = stored(batch, "batch")  # read several times; the state is gone through once
        status = batch.groupBy("case_id").agg(F.when(F.bool_and("whole"), "ok").otherwise("incomplete").alias("status"))
        voxels = batch.where("x is not null").drop("whole")
        case_metrics(voxels, status, voxel_ml, grid).join(status, "case_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).where("case_id is not null and part is not null")
    whole = rows.groupBy("case_id").applyInPandasWithState(whole_cases(wait_ms), shown, WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout)
    whole.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
