"""Embedding whitening by incremental eigendecomposition.

Every task holds the eigenvalues and eigenvectors of the scatter of the vectors
it has seen. Further vectors come as centred rank-one updates (those of a batch
first made triangular, so a batch takes as many as there are dimensions): with z
the vector in the eigenbasis, the new eigenvalues are the roots of the secular equation
1 + rho * sum(z_j^2 / (l_j - m)) = 0, one between each two old ones, and the new
eigenvectors follow from weights that fit the computed roots exactly, so they
stay orthogonal. Entries of z that are negligible, and pairs of equal
eigenvalues after a rotation, keep their eigenpairs (deflation). Two spectra are
combined by one such update for every eigenpair of the second and one for the
distance of the means; that happens in a tree of bounded fan-in, so no task
holds more than a few spectra. At last the vectors are projected on the found
basis once more, the small covariance there is added up over all tasks, and its
eigenvectors turn the basis (Rayleigh-Ritz), which leaves no drift of the many
updates.

Entries c count as whole numbers x = floor(64 c) + 1,000,000; sums of x are exact.

Defined results: vectors that are null or hold null or non-finite entries, or
entries whose x no 64-bit integer holds, are left out, and so are empty ones;
vectors of each length are a list of their own, with n, components and
identity_error of their own; repeated rows count and repeat; a null vec_id is
kept as it is; ties of eigenvalues give any orthonormal basis of their space;
components without variance have whitened null (explained null if no component
has any) and are left out of identity_error, which is null if none is left; a
deviation beyond 64 bits is null; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import stored, table

SHIFT = 1_000_000
#: Spectra or sums that one task combines.
FAN_IN = 16
EPS = float(np.finfo(np.float64).eps)
EXACT = 2**62


class Spectrum:
    """n vectors y = x - SHIFT: their exact sums and the eigenpairs of their centred scatter, eigenvalues ascending."""

    def __init__(self, dims: int) -> None:
        self.n, self.sums = 0, [0] * dims
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def mean(self) -> np.ndarray:
        return np.asarray([s / self.n for s in self.sums])

    def add(self, rows: np.ndarray) -> None:
        """Takes in vectors by centred rank-one updates: one each, or where a batch has more vectors than dimensions one for each row of the triangular factor of the centred batch, which has the same scatter, and one for the distance of its mean."""
        n, y = len(rows), rows.astype(np.float64)
        exact = rows if n * int(np.abs(rows).max(initial=0)) < EXACT else rows.astype(object)
        sums = [int(s) for s in exact.sum(axis=0)]
        if n > y.shape[1]:
            middle = np.asarray([s / n for s in sums])
            for row in np.linalg.qr(y - middle, mode="r"):
                self.update(1.0, row)
            if self.n:
                self.update(self.n * n / (self.n + n), middle - self.mean())
        else:
            mean = self.mean() if self.n else y[0]
            for k, row in enumerate(y, self.n):
                away = row - mean
                if k:
                    self.update(k / (k + 1), away)
                mean = mean + away / (k + 1)
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def merge(self, other: Spectrum) -> None:
        """Takes in another list by its eigenpairs and its mean."""
        if self.n and other.n:
            away = other.mean() - self.mean()
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                if value > 0:
                    self.update(value, vector)
            self.update(self.n * other.n / (self.n + other.n), away)
        elif other.n:
            self.values, self.vectors = other.values, other.vectors
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def update(self, rho: float, v: np.ndarray) -> None:
        """The eigenpairs of the scatter plus rho * v v'."""
        z = v @ self.vectors
        size = float(np.sqrt(z @ z))
        if not size:
            return
        z, rho = z / size, rho * size * size
        tol = 8 * EPS * max(float(self.values[-1]), rho)
        keep = np.flatnonzero(rho * np.abs(z) > tol)
        if len(keep) > 1:
            keep = self._deflate(z, keep, tol)
        if not len(keep):
            return
        d, origin, tau = self.values[keep], *secular(self.values[keep], z[keep] ** 2 * rho)
        gap = (origin[:, None] - d[None, :]) + tau[:, None]  # root k minus pole j
        poles = d[:, None] - d[None, :]
        np.fill_diagonal(poles, 1.0)
        weight = np.sqrt(np.abs(np.prod(gap / poles, axis=0))) * np.sign(z[keep])  # the diagonal of gap / poles is root j minus pole j
        turn = weight[:, None] / gap.T
        turn /= np.sqrt((turn * turn).sum(axis=0))
        self.vectors[:, keep] = self.vectors[:, keep] @ turn
        self.values[keep] = origin + tau
        if (np.diff(self.values) < 0).any():
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], np.ascontiguousarray(self.vectors[:, order])

    def _deflate(self, z: np.ndarray, keep: np.ndarray, tol: float) -> np.ndarray:
        """Rotates eigenpairs of (nearly) equal values so that one of each two has no weight; those with weight are returned."""
        a, b = keep[:-1], keep[1:]
        close = np.diff(self.values[keep]) * np.abs(z[a] * z[b]) / (z[a] ** 2 + z[b] ** 2) <= tol
        if not close.any():
            return keep
        out, last = [], keep[0]
        for k in keep[1:]:
            tau = np.hypot(z[last], z[k])
            c, s = z[k] / tau, z[last] / tau
            if (self.values[k] - self.values[last]) * abs(c * s) <= tol:
                low, high = self.vectors[:, last].copy(), self.vectors[:, k].copy()
                self.vectors[:, last], self.vectors[:, k] = c * low - s * high, s * low + c * high
                x, y = self.values[last], self.values[k]
                self.values[last], self.values[k] = c * c * x + s * s * y, s * s * x + c * c * y
                z[last], z[k] = 0.0, tau
            else:
                out.append(last)
            last = k
        return np.asarray([*out, last])


def secular(d: np.ndarray, w: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w_j / (d_j - m)) = 0 as the nearest pole and the distance from it; d ascending and distinct, w above 0.

    Each step fits a rational function with the two neighbouring poles to the
    terms on either side of the root, and halves the bracket where that leaves
    it. All roots go together.
    """
    k, i = len(d), np.arange(len(d))
    upper = np.append(d[1:], d[-1] + w.sum())
    half = (upper - d) / 2
    below = np.append((1 + (w / (d[None, :] - (d[:-1] + half[:-1])[:, None])).sum(axis=1)) >= 0, True)  # the root lies in the lower half
    origin = np.where(below, d, upper)
    delta = d[None, :] - origin[:, None]
    low = np.where(below, 0.0, -half)
    high = np.where(below, np.where(i == k - 1, upper - d, half), 0.0)
    tau = (low + high) / 2
    left = (i[None, :] <= i[:, None]).astype(np.float64)
    for _ in range(rounds):
        r = 1 / (delta - tau[:, None])
        f = 1 + r @ w
        noise = 1 + np.abs(r) @ w
        low, high = np.where(f < 0, tau, low), np.where(f > 0, tau, high)
        slope = (r * r * left) @ w, r * r @ w
        psi, phi = slope[0], slope[1] - slope[0]
        a1 = 1 / r[i, i]
        a2 = np.append(1 / r[i[:-1], i[1:]], 1.0)
        total = (a1 + a2) * f - a1 * a2 * (psi + phi)
        product, c = a1 * a2 * f, f - a1 * psi - a2 * phi
        root = np.sqrt(np.maximum(total * total - 4 * product * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(total <= 0, (total - root) / (2 * c), 2 * product / (total + root))
            step[-1] = a1[-1] + a1[-1] ** 2 * psi[-1] / (f[-1] - a1[-1] * psi[-1])
        new = tau + step
        lost = ~((new > low) & (new < high))
        new[lost] = (low[lost] + high[lost]) / 2
        done = (np.abs(f) <= 8 * EPS * noise) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        new = np.where(done, tau, new)
        if done.all() or (new == tau).all():
            break
        tau = new
    return origin, tau


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, their y as int64) of each length of vectors in a batch."""
    lists = batch.column(column)
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    for dims in np.unique(lens).tolist():
        at = np.flatnonzero(lens == dims)
        yield dims, at, np.floor(64 * flat[starts[at][:, None] + np.arange(dims)]).astype(np.int64)


def _states(vectors: DataFrame, start: Callable, add: Callable) -> DataFrame:
    """dims, part, state: what each task makes of its vectors of each length by start(dims) and add(state, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for dims, _, y in _by_length(batch, 0):
                found[dims] = add(found[dims] if dims in found else start(dims), y)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int64()), pa.array([pickle.dumps(s) for s in found.values()], pa.binary())], names=["dims", "part", "state"])

    return vectors.select("embedding").mapInArrow(run, "dims int, part long, state binary")


def _combined(states: DataFrame, merge: Callable) -> dict:
    """dims -> the one state of all tasks, combined in a tree of FAN_IN in order of part; its size depends on the vectors' length alone."""

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        blobs = t.column("state")
        state = pickle.loads(blobs[0].as_py())
        for k in range(1, t.num_rows):
            state = merge(state, pickle.loads(blobs[k].as_py()))
        return pa.table({"dims": t.column("dims")[:1], "part": pa.array([t.column("part")[0].as_py() // FAN_IN], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        states = states.groupBy("dims", F.floor(F.col("part") / FAN_IN)).applyInArrow(combine, "dims int, part long, state binary")
        parts = -(-parts // FAN_IN)
    return {r.dims: pickle.loads(r.state) for r in states.select("dims", "state").collect()}


def _merged(a: Spectrum, b: Spectrum) -> Spectrum:
    a.merge(b)
    return a


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums, exact: int64 where that holds them, else Python's integers."""
    small = n * int(np.abs(y).max(initial=0)) < EXACT and max(map(abs, sums)) < EXACT
    return n * y - np.asarray(sums, np.int64) if small else n * y.astype(object) - np.asarray(sums, object)


def _squares(away: np.ndarray) -> pa.Array:
    """Row sums of squares, exact; null beyond 64 bits."""
    if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < EXACT:
        return pa.array((away * away).sum(axis=1), pa.int64())
    return pa.array([s if (s := sum([int(x) ** 2 for x in row])) < 2**63 else None for row in away], pa.int64())


class Whitening:
    """Of the vectors of one length: n, exact sums, eigenvalues falling, components as columns, and the error of the whitened covariance."""

    def __init__(self, spectrum: Spectrum) -> None:
        self.n, self.sums = spectrum.n, spectrum.sums
        self.values, self.vectors = spectrum.values[::-1], np.linalg.qr(spectrum.vectors[:, ::-1])[0]
        self.error: float | None = None

    def centred(self, y: np.ndarray) -> np.ndarray:
        return _deviations(y, self.n, self.sums).astype(np.float64) / self.n

    def refine(self, projected: np.ndarray) -> None:
        """Turns the basis by the eigenvectors of the covariance in it, n times which is given."""
        values, turn = np.linalg.eigh((projected + projected.T) / (2 * self.n))
        self.values, self.vectors = np.maximum(values[::-1], 0), self.vectors @ turn[:, ::-1]

    def scale(self, most: int) -> np.ndarray:
        """1 / sqrt(e) of the first components, NaN for those without variance."""
        e = self.values[:most]
        some = e > (self.values[0] * len(self.values) * 8 * EPS if len(e) else 0)
        return np.where(some, 1 / np.sqrt(np.where(some, e, 1)), np.nan)

    def whitened(self, y: np.ndarray, most: int) -> np.ndarray:
        return self.centred(y) @ self.vectors[:, :most] * self.scale(most)

    def shares(self, most: int) -> list[float | None]:
        whole = float(self.values.sum())
        return [float(e) / whole if whole else None for e in self.values[:most]]


def _sums_of_products(vectors: DataFrame, models: dict[int, Whitening], turned: Callable) -> dict[int, np.ndarray]:
    """dims -> the sum of t' t over all vectors with t = turned(model, y), added up over tasks in a tree."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def add(state: tuple, y: np.ndarray) -> tuple:
        t = turned(shared.value[y.shape[1]], y)
        return (t.T @ t) + state

    return _combined(stored(_states(vectors, lambda dims: 0.0, add), "products"), lambda a, b: a + b)


def sound(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, of the vectors that the fit list holds."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**56))
    return embeddings.select("vec_id", v.alias("embedding")).where(fine & (F.size("embedding") > 0))


def fit(embeddings: DataFrame, components: int = 32) -> dict[int, Whitening]:
    """dims -> the whitening of the vectors of that length."""
    vectors = sound(embeddings)

    def add(state: Spectrum, y: np.ndarray) -> Spectrum:
        state.add(y)
        return state

    models = {d: Whitening(s) for d, s in _combined(stored(_states(vectors, Spectrum, add), "spectra"), _merged).items()}
    for d, b in _sums_of_products(vectors, models, lambda m, y: m.centred(y) @ m.vectors).items():
        models[d].refine(b)
    for d, b in _sums_of_products(vectors, models, lambda m, y: m.whitened(y, components)).items():
        off = np.abs(b / models[d].n - np.eye(len(b)))
        models[d].error = float(np.nanmax(off)) if np.isfinite(off).any() else None
    return models


def whiten(embeddings: DataFrame, models: dict[int, Whitening], components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component."""
    shared = embeddings.sparkSession.sparkContext.broadcast(models)
    kinds = {"component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, y in _by_length(batch, 1):
                model = shared.value[dims]
                c, rows = min(components, dims), len(at)
                every, white = np.repeat(np.arange(rows), c), model.whitened(y, c).ravel()
                columns = {
                    "component": pa.array(np.tile(np.arange(1, c + 1), rows), pa.int32()),
                    "n": pa.array(np.full(rows * c, model.n), pa.int64()),
                    "deviation": _squares(_deviations(y, model.n, model.sums)).take(pa.array(every)),
                    "whitened": pa.array(white, pa.float64(), mask=np.isnan(white)),
                    "explained": pa.array(model.shares(c) * rows, pa.float64()),
                    "identity_error": pa.array([model.error] * (rows * c), pa.float64()),
                }
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).take(pa.array(at[every]))} | columns)

    schema = f"vec_id {dict(embeddings.dtypes)['vec_id']}, " + ", ".join(f"{k} {'int' if t == pa.int32() else 'long' if t == pa.int64() else 'double'}" for k, t in kinds.items())
    return sound(embeddings).mapInArrow(run, schema)


def op13_eigen_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whiten(rows, fit(rows))
