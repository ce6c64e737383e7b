"""Steps that grow with the tables: what a task gets, what travels."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewise.operators import voxels as V
from casewise.sources import volumes
from casewise.streaming import incremental


def grid(spark, cases):
    """Every voxel of a 6 x 6 x 6 grid, for so many cases."""
    n = F.col("id")
    at = {k: (F.floor(n / 6**j) % 6).cast("int") for j, k in enumerate("xyz")}
    return spark.range(216 * cases, numPartitions=4).select(F.floor(n / 216).cast("long").alias("case_id"), *[c.alias(k) for k, c in at.items()], F.lit(1).alias("v"))


def test_resampling_deals_slices_into_many_tasks(spark):
    vox = grid(spark, 300)
    shapes = vox.select("case_id").distinct().selectExpr("case_id", "array(6, 6, 6) as source", "array(8, 7, 6) as target")
    out = V.resample(vox, shapes, ("v",)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in out) == 300 * 8 * 7 * 6
    assert max(r["count"] for r in out) < 300 * 8 * 7 * 6 / 20


@pytest.mark.parametrize("tile", [4, 128])
def test_closing_by_tiles_equals_the_definition(spark, tile):
    """Against sets of points, with voxels on and beyond the borders of tiles and grid; fewer rows travel than a voxel has neighbours."""
    draw, shape = np.random.default_rng(5), (11, 9, 7)
    cases = {c: {tuple(p) for p in draw.integers((-2, -2, -1), (14, 12, 10), (n, 3)).tolist()} for c, n in ((0, 200), (1, 60), (2, 1))}
    rows = spark.createDataFrame([(c, *p, 1) for c, s in cases.items() for p in s] + [(3, 1, 1, 1, 0), (4, 10**6, 0, 0, 1)], "case_id long, x int, y int, z int, gt int")
    got = V.close_mask(rows, "gt", (2.4, 2.4, 1.0), shape, 1, tile=tile)
    element = [(dx, dy, 0) for dx in range(-2, 3) for dy in range(-2, 3) if dx * dx + dy * dy <= 4] + [(0, 0, -1), (0, 0, 1)]
    inside = lambda p: 0 <= p[0] < 11 and 0 <= p[1] < 9 and 1 <= p[2] < 8
    around = lambda p: {q for d in element if inside(q := tuple(a + b for a, b in zip(p, d, strict=True)))}
    want = set()
    for c, s in cases.items():
        grown = set().union(*map(around, s))
        want |= {(c, *p) for p in set().union(*map(around, grown)) if around(p) <= grown}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_closing_takes_one_shuffle(spark):
    plan = V.close_mask(grid(spark, 2), "v", (4.0, 4.0, 1.0), (6, 6, 6), 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_small_volumes_are_read_by_many_tasks_in_few_batches(tmp_path, monkeypatch):
    """Files of some hundred bytes: a partition has a bounded number of them, and one batch has the voxels of several."""
    for k in range(1100):
        np.save(tmp_path / f"{k:04d}.npy", np.full((2, 2, 2), 3, np.uint8))
    reader = volumes.VolumeReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert [len(p.value) for p in parts] == [512, 512, 76]
    batches = list(reader.read(parts[2]))
    assert len(batches) == 1 and batches[0].num_rows == 76 * 8
    assert batches[0].column("case_id").to_pylist()[::8] == [f"{k:04d}" for k in range(1024, 1100)]


class Kept:
    """A group's state as Spark keeps it between batches."""

    exists, get, hasTimedOut, now = False, None, False, 1000

    def update(self, row):
        self.exists, self.get = True, row

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def test_a_waiting_case_takes_one_state_row_and_keeps_its_deadline():
    gather, state = incremental.whole_cases(500), Kept()
    part = lambda k, *rows: pd.DataFrame([(7, k, 3, *r) for r in rows], columns=["case_id", "part", "parts", *incremental.COLUMNS])
    come = lambda *frames: [f.values.tolist() for f in gather((7,), iter(frames), state)]
    assert come(part(0, (1, 2, 3, 1, 0), (1, 2, 3, 1, 0)), part(2, (None,) * 5)) == []
    assert state.ms == 500 and len(state.get[0]) == 2
    state.now = 1400
    assert come(part(0, (9, 9, 9, 1, 1))) == [] and state.ms == 100
    (done,) = come(part(1, (4, 4, 4, 0, 1)))
    assert sorted(done) == [[7, 1, 2, 3, 1, 0, True], [7, 4, 4, 4, 0, 1, True]] and not state.exists
    come(part(0, (1, 1, 1, 1, 1)))
    state.hasTimedOut = True
    assert come() == [[[7, 1, 1, 1, 1, 1, False]]] and not state.exists


def test_small_tiles_are_labelled_by_few_calls():
    """Groups cut by batches are put together; neighbours in different tiles or cases get labels of their own."""
    draw, half = np.random.default_rng(2), [o for o in V.offsets(18) if o[::-1] > (0, 0, 0)]
    sizes = {("a", 0): 30, ("a", 1): 1, (None, 0): 25, ("b", 0): 90}
    rows = [(case, t, *p) for (case, t), n in sizes.items() for p in sorted({tuple(q) for q in draw.integers(0, 4, (n, 3)).tolist()})]
    table = pa.table({k: [r[j] for r in rows] for j, k in enumerate(("case_id", "_t", "x", "y", "z"))}).append_column("_key", pa.array([(r[4] * 4 + r[3]) * 4 + r[2] for r in rows]))
    for size in (1, 7, 1000):
        groups = list(V.whole_groups(iter(table.to_batches(max_chunksize=size)), ["case_id", "_t"]))
        assert pa.concat_tables(groups).equals(table)
        assert size < 1000 or len(groups) == 2  # all but the last group, which waits for more
        assert all(len({(a, b) for a, b in zip(*(g.column(k).to_pylist() for k in ("case_id", "_t")), strict=True)} & {(a, b) for a, b in zip(*(h.column(k).to_pylist() for k in ("case_id", "_t")), strict=True)}) == 0 for g in groups for h in groups if g is not h)
        got = [x for g in groups for x in V.label_tiles(g, ["case_id", "_t"], 4, half).column("_label").to_pylist()]
        want = []
        for case, t in sizes:
            own = [r for r in rows if r[:2] == (case, t)]
            comp, keys = V._labels(np.asarray([r[2:] for r in own]).T, half), [(r[4] * 4 + r[3]) * 4 + r[2] for r in own]
            want += [min(k for k, d in zip(keys, comp, strict=True) if d == c) for c in comp]
        assert got == want
