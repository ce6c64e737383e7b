"""Volume files as a Spark data source: NIfTI-1 (.nii, .nii.gz) and .npy, read into voxel rows and written from them.

Files are listed once on the driver; small ones share a partition, at most 512 of
them, a large one has its own; batches go on from file to file. A task parses a file's header from its first bytes and then streams
it slab by slab (one index of the slowest axis), so it holds one slab whatever
the volume's size. Conditions on the value, the coordinates and the case go down
to the reader: only voxels that pass become rows, and files of other cases are
not opened. The second table, ``cases``, has a row per file from headers alone.

The sink takes voxel rows sorted by case and slice and streams each case into a
file under a temporary name; only the commit of the whole job gives the files
their names, so an attempt that failed or ran twice leaves nothing behind.

Paths go through pyarrow's file systems, so local and shared folders, HDFS and
object stores work alike.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from casewise.operators.ordering import dealt

NAME = "voxel_files"
VOXELS = "case_id string, x int, y int, z int, v double"
CASES = "case_id string, path string, nx int, ny int, nz int, channels int, sx double, sy double, sz double, kind string, status string"
#: Bytes of small files that share a partition; bytes that a file counts as at least, since opening one takes time; rows of a batch.
SHARE_BYTES = 32 << 20
FILE_BYTES = 64 << 10
BATCH_ROWS = 1 << 14
#: Files renamed at the same time.
MOVES = 16
SUFFIXES = (".nii.gz", ".nii", ".npy")
#: NIfTI-1 data types by code: fixed values of the format.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER_BYTES = 348


@dataclass
class Header:
    """What a volume's first bytes say; `axes` are the places of x, y, z (and the channel, 3) from the fastest to the slowest axis."""

    shape: tuple[int, int, int]
    channels: int
    spacing: tuple[float, float, float]
    kind: np.dtype
    axes: tuple[int, ...]
    slope: float = 1.0
    inter: float = 0.0


def _exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    out = stream.read(n)
    if len(out) < n:
        raise ValueError(f"ends after {len(out)} of {n} bytes")
    return out


def nifti_header(stream: io.BufferedIOBase) -> Header:
    """Reads the header and moves to the first voxel."""
    raw = _exactly(stream, HEADER_BYTES)
    end = next((e for e in "<>" if struct.unpack_from(e + "i", raw)[0] == HEADER_BYTES), None)
    if end is None or raw[344:347] != b"n+1":
        raise ValueError("no NIfTI-1 file in one part")
    dims, pixdim = struct.unpack_from(end + "8h", raw, 40), struct.unpack_from(end + "8f", raw, 76)
    code, (start, slope, inter) = struct.unpack_from(end + "h", raw, 70)[0], struct.unpack_from(end + "3f", raw, 108)
    if code not in KINDS or not 1 <= dims[0] <= 7 or min(dims[1 : dims[0] + 1]) < 1:
        raise ValueError(f"data type {code}, dimensions {dims}")
    size = [*dims[1 : dims[0] + 1], *[1] * 7][:7]
    _exactly(stream, int(start) - HEADER_BYTES)
    scaled = slope not in (0.0, 1.0) or (slope == 1.0 and inter != 0.0)
    return Header(tuple(size[:3]), int(np.prod(size[3:])), tuple(pixdim[1:4]), np.dtype(end + KINDS[code]), (0, 1, 2, 3), slope if scaled else 1.0, inter if scaled else 0.0)


def npy_header(stream: io.BufferedIOBase) -> Header:
    """The same for an array of axes x, y, z, or channel, x, y, z; spacing is unknown and 1."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) not in (3, 4) or kind.hasobject:
        raise ValueError(f"an array of shape {shape}")
    axes = (0, 1, 2) if len(shape) == 3 else (3, 0, 1, 2)
    axes = axes if fortran else axes[::-1]
    return Header(tuple(shape[-3:]), shape[0] if len(shape) == 4 else 1, (1.0, 1.0, 1.0), kind, axes)


def open_volume(system: fs.FileSystem, path: str) -> tuple[io.BufferedIOBase, Header]:
    raw = system.open_input_stream(path, compression=None)
    stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
    return stream, npy_header(stream) if path.endswith(".npy") else nifti_header(stream)


def slabs(stream: io.BufferedIOBase, h: Header, channel: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(values, [x, y, z]) of every slab of the slowest axis, of one channel."""
    sizes = {0: h.shape[0], 1: h.shape[1], 2: h.shape[2], 3: h.channels}
    axes = [a for a in h.axes if a != 3 or h.channels > 1]
    slow, inner = axes[-1], [sizes[a] for a in axes[:-1]]
    if slow == 3:  # whole channels one after the other: those before are read over
        skip = int(np.prod(inner)) * h.kind.itemsize * channel
        while skip:
            skip -= len(_exactly(stream, min(skip, 1 << 24)))
        axes, slow, inner = axes[:-1], axes[-2], inner[:-1]
    n = int(np.prod(inner))
    grid = np.unravel_index(np.arange(n), inner, order="F")
    for k in range(sizes[slow]):
        v = np.frombuffer(_exactly(stream, n * h.kind.itemsize), h.kind).astype(np.float64) * h.slope + h.inter
        at = dict(zip(axes[:-1], grid, strict=True)) | {slow: np.full(n, k)}
        if 3 in at:
            of = at[3] == channel
            v, at = v[of], {a: c[of] for a, c in at.items()}
        yield v, [at[a] for a in (0, 1, 2)]


def _passes(v: np.ndarray, f: ds.Filter) -> np.ndarray:
    """Which values a condition keeps; NaN is above all numbers, as in Spark."""
    nan = np.isnan(v)
    match f:
        case ds.GreaterThan():
            return (v > f.value) | nan
        case ds.GreaterThanOrEqual():
            return (v >= f.value) | nan
        case ds.LessThan():
            return v < f.value
        case ds.LessThanOrEqual():
            return v <= f.value
        case ds.EqualTo():
            return v == f.value
        case ds.In():
            return np.isin(v, [x for x in f.value if x is not None])
        case ds.Not():
            return ~_passes(v, f.child)
        case _:
            return np.ones(len(v), bool)


def case_of(path: str) -> str:
    """The file name without its suffix."""
    name = path.rsplit("/", 1)[-1]
    return next(name[: -len(s)] for s in SUFFIXES if name.endswith(s))


class VolumeReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options.get("table", "voxels")
        self.channel, self.skip = int(options.get("channel", 0)), options.get("errors", "fail") == "skip"
        self.share, self.filters = int(options.get("share_bytes", SHARE_BYTES)), []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        plain = (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.EqualTo, ds.In)
        for f in filters:
            inner = f.child if isinstance(f, ds.Not) else f
            column = getattr(inner, "attribute", ("",))
            on_case = column == ("case_id",) and isinstance(f, (ds.EqualTo, ds.In))
            number = self.table == "voxels" and column in (("v",), ("x",), ("y",), ("z",))
            value = getattr(inner, "value", None)
            sound = value is not None and all(x is not None and x == x for x in (value if isinstance(value, (tuple, list)) else (value,)))
            if isinstance(f, ds.IsNotNull) and (number or column == ("case_id",)):
                continue  # none of these is ever null
            if sound and isinstance(inner, plain) and (on_case or number):
                self.filters.append(f)
            else:
                yield f

    def _of(self, column: str) -> list[ds.Filter]:
        return [f for f in self.filters if (f.child if isinstance(f, ds.Not) else f).attribute == (column,)]

    def partitions(self) -> list[ds.InputPartition]:
        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(base)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(base) :].split("/"))
        files = [f for f in files if f.is_file and f.path.endswith(SUFFIXES) and not (f.path != base and hidden(f.path))]
        for f in self._of("case_id"):
            wanted = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            files = [x for x in files if case_of(x.path) in wanted]
        groups, size = [], self.share
        for f in sorted(files, key=lambda f: f.path):
            counted = max(f.size, FILE_BYTES)
            if not groups or size + counted > self.share:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += counted
        return [ds.InputPartition(g) for g in groups]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0]
        small, rows = [], 0
        for path in partition.value:
            try:
                for batch in self._case(system, path) if self.table == "cases" else self._voxels(system, path):
                    small.append(batch)
                    rows += batch.num_rows
                    if rows >= BATCH_ROWS:
                        yield _joined(small)
                        small, rows = [], 0
            except (ValueError, OSError, EOFError) as e:
                if self.table == "cases":
                    small.append(_cases_row(path, None, f"{type(e).__name__}: {e}"))
                    rows += 1
                elif not self.skip:
                    raise ValueError(f"{path}: {e}") from e
        if small:
            yield _joined(small)

    def _case(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        yield _cases_row(path, open_volume(system, path)[1], "ok")

    def _voxels(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        stream, h = open_volume(system, path)
        if self.channel >= h.channels:
            raise ValueError(f"no channel {self.channel} of {h.channels}")
        with stream:
            for v, at in slabs(stream, h, self.channel):
                keep = np.ones(len(v), bool)
                for name, values in zip(("v", "x", "y", "z"), (v, *at), strict=True):
                    for f in self._of(name):
                        keep &= _passes(values.astype(np.float64), f)
                if keep.any():
                    n = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([case_of(path)] * n), *[pa.array(c[keep], pa.int32()) for c in at], pa.array(v[keep])], names=["case_id", "x", "y", "z", "v"])


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _cases_row(path: str, h: Header | None, status: str) -> pa.RecordBatch:
    told = [*h.shape, h.channels, *map(float, h.spacing), h.kind.name] if h else [None] * 8
    kinds = [pa.string()] * 2 + [pa.int32()] * 4 + [pa.float64()] * 3 + [pa.string()] * 2
    names = [c.split()[0] for c in CASES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([case_of(path), path, *told, status], kinds, strict=True)], names=names)


@dataclass
class Written(ds.WriterCommitMessage):
    """(temporary name, file name) of each volume that a task wrote."""

    files: list[tuple[str, str]]


class VolumeFile:
    """One volume, written slice by slice in order of z."""

    def __init__(self, system: fs.FileSystem, path: str, shape: tuple[int, int, int], spacing: tuple[float, float, float], kind: np.dtype) -> None:
        if min(shape) < 1 or max(shape) > 32767:
            raise ValueError(f"no volume has the shape {shape}")
        self.shape, self.kind, self.z = shape, kind, 0
        self.raw = system.open_output_stream(path, compression=None)
        self.stream = gzip.GzipFile(fileobj=self.raw, mode="wb", compresslevel=4, mtime=0) if path.endswith(".gz") else self.raw
        code = next(k for k, v in KINDS.items() if np.dtype(v) == kind)
        head = bytearray(HEADER_BYTES + 4)  # four bytes say that no extension follows
        struct.pack_into("<i", head, 0, HEADER_BYTES)
        struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
        struct.pack_into("<2h", head, 70, code, kind.itemsize * 8)
        struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
        struct.pack_into("<3f", head, 108, HEADER_BYTES + 4, 1.0, 0.0)
        head[123] = 2  # millimetres
        head[344:348] = b"n+1\0"
        self.stream.write(bytes(head))
        self._clear()

    def _clear(self) -> None:
        self.slice = np.zeros((self.shape[1], self.shape[0]), self.kind.newbyteorder("<"))

    def _turn_to(self, z: int) -> None:
        while self.z < z:
            self.stream.write(self.slice.tobytes())
            self.z += 1
            self._clear()

    def put(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, v: np.ndarray) -> None:
        """Voxels in order of z; of several at one place the last counts."""
        for c, n in zip((x, y, z), self.shape, strict=True):
            if len(c) and (c.min() < 0 or c.max() >= n):
                raise ValueError(f"a voxel lies outside the grid {self.shape}")
        cast = v.astype(self.kind)
        if self.kind.kind != "f" and (cast != v).any():
            raise ValueError(f"a value does not fit {self.kind.name}")
        cuts = np.flatnonzero(np.diff(z)) + 1
        for at in np.split(np.arange(len(z)), cuts) if len(z) else ():
            self._turn_to(int(z[at[0]]))
            self.slice[y[at], x[at]] = cast[at]

    def close(self) -> None:
        self._turn_to(self.shape[2])
        self.stream.close()
        if not self.raw.closed:
            self.raw.close()


class VolumeWriter(ds.DataSourceArrowWriter):
    """Rows case_id, nx, ny, nz, sx, sy, sz, x, y, z, v, sorted by case and z, a case's rows in one partition; x null in a case without voxels."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.kind, self.suffix = np.dtype(options.get("kind", "uint8")), options.get("suffix", ".nii.gz")
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{base}/{self.job}", recursive=True)
        attempt, files, now, volume = uuid.uuid4().hex, [], None, None
        for batch in iterator:
            cases, (nx, ny, nz, sx, sy, sz) = batch.column("case_id").to_pylist(), (batch.column(k) for k in ("nx", "ny", "nz", "sx", "sy", "sz"))
            there = np.asarray(batch.column("x").is_valid())
            x, y, z, v = (np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False)) if batch.column(k).null_count else batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "z", "v"))
            borders = [0, *[k for k in range(1, len(cases)) if cases[k] != cases[k - 1]], len(cases)]
            for a, b in zip(borders, borders[1:], strict=False):
                if b > a and cases[a] != now:
                    if volume:
                        volume.close()
                    now, names = cases[a], (f"{base}/{self.job}/{attempt}-{len(files)}{self.suffix}", f"{base}/{cases[a]}{self.suffix}")
                    files.append(names)
                    volume = VolumeFile(system, names[0], tuple(c[a].as_py() for c in (nx, ny, nz)), tuple(c[a].as_py() for c in (sx, sy, sz)), self.kind)
                at = a + np.flatnonzero(there[a:b])
                volume.put(*[c[at].astype(np.int64) for c in (x, y, z)], v[at])
        if volume:
            volume.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        files = [pair for m in messages if m for pair in m.files]
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.is_file and f.path.endswith(SUFFIXES):
                    system.delete_file(f.path)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda pair: system.move(*pair), files))
        self._clean(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.path))

    def _clean(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


class VolumeSource(ds.DataSource):
    """``spark.read.format("voxel_files")``: options path, table (voxels or cases), channel, errors (fail or skip), share_bytes; written with kind and suffix."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CASES if self.options.get("table") == "cases" else VOXELS

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)


def read_volumes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """case_id, x, y, z, v of every voxel of the volumes under a path; a condition such as ``v > 0`` is met in the reader."""
    _ready(spark)
    return spark.read.format(NAME).options(**options).load(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per volume from its header: shape, spacing in mm, data type; status is ok or what is wrong with the file."""
    _ready(spark)
    return spark.read.format(NAME).option("table", "cases").load(path)


def write_volumes(vox: DataFrame, cases: DataFrame, path: str, value: str, kind: str = "uint8", mode: str = "append", suffix: str = ".nii.gz") -> None:
    """A volume per row of `cases` (case_id, nx, ny, nz, sx, sy, sz), 0 where `vox` (case_id, x, y, z and the value) has no row; coordinates count from 0.

    Cases meet their voxels in one shuffle by case into many tasks, and a task streams
    its cases one after the other. Of several rows of one voxel the greatest value counts.
    """
    _ready(vox.sparkSession)
    voxels = vox.where(F.col(value).isNotNull()).select("case_id", *[F.col(k).cast("int").alias(k) for k in "xyz"], F.col(value).cast("double").alias("v"))
    dims = cases.select("case_id", *[F.col(k).cast("int").alias(k) for k in ("nx", "ny", "nz")], *[F.col(k).cast("double").alias(k) for k in ("sx", "sy", "sz")])
    rows = dealt(dims.join(voxels, "case_id", "left"), "case_id").sortWithinPartitions("case_id", "z", "y", "x", "v")
    rows.withColumn("case_id", F.col("case_id").cast("string")).write.format(NAME).option("kind", kind).option("suffix", suffix).mode(mode).save(path)
