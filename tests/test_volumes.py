"""Volume files and tiled components against direct computation."""

import gzip
import os
import re
import struct
import subprocess
import sys
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from casewise.operators import graph, voxels
from casewise.sources import volumes


def nifti(values, spacing=(1.0, 1.0, 1.0), code=16, end="<", slope=0.0, inter=0.0, start=352):
    """A file's bytes; values in order of axes x, y, z[, channel]."""
    head = bytearray(start)
    dims = [values.ndim, *values.shape, *[1] * 7][:8]
    struct.pack_into(end + "i", head, 0, 348)
    struct.pack_into(end + "8h", head, 40, *dims)
    struct.pack_into(end + "2h", head, 70, code, 32)
    struct.pack_into(end + "8f", head, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into(end + "3f", head, 108, start, slope, inter)
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype(end + volumes.KINDS[code]).tobytes(order="F")


def dense(rows, shape):
    out = np.zeros(shape)
    for r in rows:
        out[r.x, r.y, r.z] = r.v
    return out


def test_reads_every_form(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, (3, 4, 5))
    for name, raw in {
        "le.nii": nifti(a, (1.5, 2.0, 3.0)),
        "be.nii": nifti(a, code=4, end=">"),
        "far.nii": nifti(a, code=2, start=400),
        "scaled.nii": nifti(a, code=8, slope=0.5, inter=1.0),
        "zipped.nii.gz": gzip.compress(nifti(a, code=64)),
        "many.nii": nifti(np.stack([a, a + 10], axis=3), code=512),
    }.items():
        (tmp_path / name).write_bytes(raw)
    np.save(tmp_path / "plain.npy", a.astype(np.int16))
    np.save(tmp_path / "fortran.npy", np.asfortranarray(a))
    np.save(tmp_path / "channels.npy", np.stack([a, a + 10]))
    np.save(tmp_path / "mixed.npy", np.asfortranarray(np.stack([a, a + 10])))
    (tmp_path / "_hidden.nii").write_bytes(b"no volume")
    uri = f"file://{tmp_path}"
    got = volumes.read_volumes(spark, uri).collect()
    by = {k: dense([r for r in got if r.case_id == k], a.shape) for k in {r.case_id for r in got}}
    assert set(by) == {"le", "be", "far", "scaled", "zipped", "many", "plain", "fortran", "channels", "mixed"} and len(got) == 10 * a.size
    assert all((v == (a * 0.5 + 1 if k == "scaled" else a)).all() for k, v in by.items())
    several = [volumes.read_volumes(spark, f"{uri}/{n}", channel="1").collect() for n in ("many.nii", "channels.npy", "mixed.npy")]
    assert all((dense(rows, a.shape) == a + 10).all() for rows in several)
    cases = {r.case_id: r for r in volumes.read_cases(spark, uri).collect()}
    assert (cases["le"].nx, cases["le"].ny, cases["le"].nz, cases["le"].sx, cases["le"].sz, cases["le"].status) == (3, 4, 5, 1.5, 3.0, "ok")
    assert cases["many"].channels == 2 and cases["plain"].kind == "int16"


def test_conditions_are_met_in_the_reader(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4)
    for name in ("one", "two"):
        (tmp_path / f"{name}.nii").write_bytes(nifti(a))
    (tmp_path / "bad.nii").write_bytes(b"short")
    vox = volumes.read_volumes(spark, f"file://{tmp_path}")
    some = vox.where("case_id in ('one', 'two') and v > 5 and v <= 20 and v <> 7 and x = 1 and z in (1, 3)")
    assert sorted((r.case_id, r.v) for r in some.collect()) == sorted((c, float(v)) for c in ("one", "two") for v in (13, 15, 17, 19))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    reader = volumes.VolumeReader({"path": f"file://{tmp_path}", "share_bytes": "1"})
    assert list(reader.pushFilters([ds.EqualTo(("case_id",), "one"), ds.GreaterThan(("v",), 22), ds.StringContains(("case_id",), "o")])) == [ds.StringContains(("case_id",), "o")]
    assert [p.value for p in reader.partitions()] == [[f"{tmp_path}/one.nii"]]
    assert [b.num_rows for b in reader.read(reader.partitions()[0])] == [1]
    assert len(volumes.VolumeReader({"path": f"file://{tmp_path}", "share_bytes": "1"}).partitions()) == 3
    assert len(volumes.VolumeReader({"path": f"file://{tmp_path}"}).partitions()) == 1


def test_broken_files(spark, tmp_path):
    a = np.ones((2, 2, 2))
    (tmp_path / "good.nii").write_bytes(nifti(a))
    (tmp_path / "cut.nii").write_bytes(nifti(a)[:-1])
    (tmp_path / "kind.nii").write_bytes(nifti(a).replace(b"n+1\0", b"ni1\0"))
    (tmp_path / "zip.nii.gz").write_bytes(b"not gzip at all")
    uri = f"file://{tmp_path}"
    status = {r.case_id: r.status for r in volumes.read_cases(spark, uri).collect()}
    assert status["good"] == "ok" and status["cut"] == "ok" and "NIfTI" in status["kind"] and status["zip"] != "ok"
    whole = volumes.read_volumes(spark, uri, errors="skip").groupBy("case_id").count().collect()
    assert {r.case_id: r["count"] for r in whole} == {"good": 8, "cut": 4}  # slabs before the damage
    with pytest.raises(Exception, match="cut.nii"):
        volumes.read_volumes(spark, f"{uri}/cut.nii").count()


def rows_of(case, voxels, shape=(4, 3, 2)):
    n = len(voxels)
    columns = {"case_id": [case] * n} | {f"n{k}": [s] * n for k, s in zip("xyz", shape, strict=True)} | {f"s{k}": [1.0] * n for k in "xyz"}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array([v[i] for v in voxels], t) for i, (k, t) in enumerate((("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()), ("v", pa.float64())))})


def test_only_the_commit_names_files(tmp_path):
    made = lambda over=False: volumes.VolumeWriter({"path": f"file://{tmp_path}/out"}, over)
    names = lambda: sorted(os.listdir(tmp_path / "out"))
    batches = [rows_of("a", [(0, 0, 0, 1.0), (3, 2, 0, 2.0)]), rows_of("a", [(1, 1, 1, 3.0)]), rows_of("b", [(None,) * 4])]

    def failing():
        yield batches[0]
        raise RuntimeError("the task dies")

    w = made()
    with pytest.raises(RuntimeError):
        w.write(failing())
    twice = [w.write(iter(batches)), w.write(iter(batches))]  # a speculative attempt besides
    assert names() == [w.job]
    w.commit([twice[1], None])
    assert names() == ["a.nii.gz", "b.nii.gz"]
    other = made(True)
    other.commit([other.write(iter([rows_of("c", [(0, 0, 0, 1.0)])]))])
    assert names() == ["c.nii.gz"]
    gone = made()
    gone.write(iter(batches))
    gone.abort([None])
    assert names() == ["c.nii.gz"]
    for bad, why in (((4, 0, 0, 1.0), "outside"), ((0, 0, 0, 300.0), "fit")):
        with pytest.raises(ValueError, match=why):
            made().write(iter([rows_of("a", [bad])]))


def test_written_volumes_are_read_back(spark, tmp_path):
    rng, path = np.random.default_rng(1), f"file://{tmp_path}/v"
    a = np.where(rng.random((5, 6, 7)) < 0.3, rng.integers(-9, 900, (5, 6, 7)), 0)
    vox = spark.createDataFrame([(1, *map(int, p), int(a[tuple(p)])) for p in np.argwhere(a)] + [(1, 0, 0, 0, None)], "case_id long, x int, y int, z int, v int")
    cases = spark.createDataFrame([(1, 5, 6, 7, 1.0, 2.0, 3.0), (2, 2, 2, 2, 1.0, 1.0, 1.0)], "case_id long, nx int, ny int, nz int, sx double, sy double, sz double")
    volumes.write_volumes(vox, cases, path, "v", kind="int16")
    back = volumes.read_volumes(spark, path).collect()
    assert (dense([r for r in back if r.case_id == "1"], a.shape) == a).all() and sum(r.case_id == "2" for r in back) == 8
    assert [(r.case_id, r.nz, r.sz) for r in volumes.read_cases(spark, path).orderBy("case_id").collect()] == [("1", 7, 3.0), ("2", 2, 1.0)]


def test_a_task_that_fails_leaves_one_file_a_case(tmp_path):
    script = f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.sql import SparkSession, functions as F
        from casewise.sources import volumes
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
        cases = spark.range(6).selectExpr("id as case_id", "2 as nx", "2 as ny", "2 as nz", "1D as sx", "1D as sy", "1D as sz")
        @F.udf("double")
        def once(case, v):
            mark = {str(tmp_path / "mark")!r}
            if case == 3 and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("first attempt")
            return v
        rows = cases.selectExpr("*", "1 as x", "1 as y", "1 as z", "1D as v").repartition(2, "case_id").sortWithinPartitions("case_id")
        rows = rows.withColumn("v", once("case_id", "v")).withColumn("case_id", F.col("case_id").cast("string"))
        spark.dataSource.register(volumes.VolumeSource)
        rows.write.format("voxel_files").mode("append").save({f"file://{tmp_path}/out"!r})
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=True, capture_output=True, timeout=200)
    assert (tmp_path / "mark").exists() and sorted(os.listdir(tmp_path / "out")) == [f"{k}.nii.gz" for k in range(6)]


@pytest.mark.parametrize(("tile", "connectivity"), [(4, 18), (8, 18), (8, 26), (4, 6)])
def test_tiled_components_equal_whole_ones(spark, tile, connectivity):
    rng = np.random.default_rng(tile)
    points = [(c, *map(int, p)) for c in (1, 2) for p in np.argwhere(rng.random((17, 16, 15)) < (0.12, 0.3)[c - 1]) - 6]
    points += [(3, k, 5, 5) for k in range(-40, 40)] + [(3, -40, k, 5) for k in range(6, 30)]  # one lesion through many tiles
    points += [(4, 7, 7, 7), (4, 8, 8, 8), (5, 7, 7, 0), (5, 8, 8, 0)]  # corner and edge across tiles
    vox = spark.createDataFrame(points, "case_id long, x int, y int, z int").withColumns({"m": F.lit(1), "_label": F.lit(1)})
    key = lambda df: sorted(tuple(r) for r in df.select("case_id", "x", "y", "z", "comp").collect())
    assert key(voxels.connected_components(vox, "m", connectivity, tile=tile)) == key(voxels.connected_components(vox, "m", connectivity))


def test_tiled_components_of_nothing_and_far_voxels(spark):
    vox = spark.createDataFrame([(1, 0, 0, 0, 0)], "case_id long, x int, y int, z int, m int")
    assert voxels.connected_components(vox, "m", tile=4).count() == 0
    with pytest.raises(Exception, match="voxel key"):
        voxels.connected_components(vox.withColumns({"m": F.lit(1), "x": F.lit(1 << 21)}), "m", tile=4).count()


def test_merged_labels(spark):
    edges = [(1, k, k + 1) for k in range(60)] + [(2, 5, 3), (2, 3, 9), (2, 7, 7), (2, None, 1), (3, 2, 1), (3, 2, 1)]
    out = graph.merged(spark.createDataFrame(edges, "g long, a long, b long"), "a", "b", ("g",)).collect()
    assert sorted(map(tuple, out)) == [(1, k, 0) for k in range(61)] + [(2, 3, 3), (2, 5, 3), (2, 9, 3), (3, 1, 1), (3, 2, 1)]
