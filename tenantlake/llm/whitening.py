"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps the spectrum of the scatter of the rows it has seen. A row changes the scatter by a rank-one matrix of
its centred vector: the new eigenvalues are the roots of a secular equation, found between the old ones, after
deflation of directions that the vector doesn't touch and of equal eigenvalues; the new eigenvectors follow from the
roots. Two spectra are combined by one such update per eigenpair of the second and one for the distance of the means,
in groups of a fixed number until one is left. Distributed Rayleigh-Ritz steps on all rows, centred by the exact mean,
then refine it until the residual is at rounding level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.session import stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100000
#: Most columns of the basis that is refined; up to this dimension it is complete, and one step is exact.
BASIS = 256
STEPS = 12
#: Residual, relative to the trace, that ends the refinement.
RESIDUAL = 1e-13
#: Spectra combined by one task at a time.
FAN_IN = 16
#: Updates after which the eigenvectors are made orthonormal again.
RENEW = 2048
EPS = np.finfo(float).eps


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) for distinct ascending ``d``: the nearest pole's place and the distance from it.

    Two-pole rational steps, bisected where they leave the bracket; all roots at once. Distances from the nearest pole
    keep their relative precision, which the eigenvectors need.
    """
    k = len(d)
    top = d[-1] + z2.sum()
    right = np.append(d[1:], top)
    middle = (d + right) / 2
    rows = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 + (z2 / (d - middle[:, None])).sum(1)
    origin = np.where((at_middle < 0) & (rows < k - 1), rows + 1, rows)
    delta = d - d[origin][:, None]
    low = np.where(origin == rows, 0.0, (middle - d[origin]))
    high = np.where(origin == rows, np.where(rows == k - 1, top - d[origin], middle - d[origin]), 0.0)
    below = np.tri(k)
    x = np.where(origin == rows, high, low) / 2
    left_pole, right_pole = d - d[origin], right - d[origin]
    best, least = x.copy(), np.full(k, np.inf)
    near, far = np.empty((k, k)), np.empty((k, k))
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            np.subtract(delta, x[:, None], out=far)
            np.divide(1.0, far, out=far)
            np.multiply(far, below, out=near)  # poles up to the root's own, and those beyond
            far -= near
            psi, phi = near @ z2, far @ z2
            near *= near
            far *= far
            dpsi, dphi = near @ z2, far @ z2
            f = 1 + psi + phi
            better = np.abs(f) < least
            best[better], least[better] = x[better], np.abs(f[better])
            small = np.abs(f) <= 8 * EPS * (1 + np.abs(psi) + np.abs(phi) + np.abs(x) * (dpsi + dphi))
            high = np.where(f > 0, np.minimum(high, x), high)
            low = np.where(f < 0, np.maximum(low, x), low)
            narrow = high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if np.all(small | narrow):
                break
            one, two = left_pole - x, right_pole - x
            c = f - one * dpsi - two * dphi
            a = (one + two) * f - one * two * (dpsi + dphi)
            b = one * two * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        x = np.where(small | narrow, x, new)
    return origin, np.where(best != 0, best, np.where(low != 0, low, high))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending) of ``vectors diag(values) vectors' + v v'``, from that of the first."""
    z = vectors.T @ v
    norm = float(z @ z)
    if norm == 0.0:
        return values, vectors
    tol = 8 * EPS * max(float(np.abs(values).max()), norm)
    live = np.flatnonzero(np.abs(z) * np.sqrt(norm) > tol)
    if len(live) > 1:
        close = np.flatnonzero(np.diff(values[live]) <= tol)
        if len(close):  # rotate equal eigenvalues so that the vector touches the last of them only
            vectors = vectors.copy()
            for at in close:
                i, j = live[at], live[at + 1]
                r = np.hypot(z[i], z[j])
                if r == 0:
                    continue
                c, s = z[j] / r, z[i] / r
                vi, vj = vectors[:, i].copy(), vectors[:, j].copy()
                vectors[:, i], vectors[:, j] = c * vi - s * vj, s * vi + c * vj
                z[i], z[j] = 0.0, r
            live = np.flatnonzero(np.abs(z) * np.sqrt(norm) > tol)
    if not len(live):
        return values, vectors
    d, z2 = values[live], z[live] ** 2
    k = len(d)
    origin, shift = _roots(d, z2)
    # differences root - d, from the nearest pole
    gap = (d[origin][:, None] - d) + shift[:, None]
    if k > 1:
        # the vector for which these are the exact eigenvalues keeps the eigenvectors orthogonal
        i, j = np.arange(k)[:, None], np.arange(k)
        other = np.where(i < j, d[:, None] - d, np.append(d[1:], 0.0)[:, None] - d)
        other[-1] = 1.0
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            near = np.sqrt(np.abs(np.prod(gap / other, 0)))
            turn = np.copysign(near, z[live])[:, None] / -gap.T
        lost = ~np.isfinite(turn)
        if lost.any():  # a root on a pole: the eigenvector is that pole's
            turn[:, lost.any(0)] = lost[:, lost.any(0)].astype(float)
        turn /= np.sqrt((turn * turn).sum(0))
        turned = vectors[:, live] @ turn
    else:
        turned = vectors[:, live]
    values, vectors = values.copy(), vectors.copy()
    values[live], vectors[:, live] = d[origin] + shift, turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Rows seen, their mean, and the spectrum of their scatter."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors, self.done = n, mean, values, vectors, 0

    @classmethod
    def of_nothing(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.done += 1
        if self.done % RENEW == 0:
            self.vectors = np.linalg.qr(self.vectors)[0]

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self._update(away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> Spectrum:
        if not self.n or not other.n:
            return self if self.n else other
        away = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * vector)
        n = self.n + other.n
        self._update(away * np.sqrt(self.n / n * other.n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n
        return self


def vectors_of(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, c): rows whose vector is there, without null or non-finite entries, and of the commonest length.

    Of lengths equally common the longest counts; a vector without entries isn't one.
    """
    c = F.col(vector).cast("array<double>")
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(whole, c).alias("c")).where("c is not null")
    found = good.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return good.where(F.size("c") == (found["width"] if found else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The whole numbers of a batch, as long."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    return flat.astype(np.int64).reshape(len(column), -1) + SHIFT


def _spectra(vectors: DataFrame, width: int) -> DataFrame:
    """One spectrum per task, with the exact sums of its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = Spectrum.of_nothing(width), np.zeros(width, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                sums += x.sum(0)
                for row in x.astype(float):
                    spectrum.add(row)
        if spectrum.n:
            yield _pack(TaskContext.get().partitionId(), spectrum, sums)

    return vectors.select("c").mapInArrow(run, _SPECTRUM)


_SPECTRUM = "place long, n long, sums array<long>, mean array<double>, vals array<double>, vecs array<double>"


def _pack(place: int, s: Spectrum, sums: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([sums], pa.list_(pa.int64()))] + [
        pa.array([a], pa.list_(pa.float64())) for a in (s.mean, s.values, s.vectors.ravel())]
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([s.n], pa.int64()), *lists],
                                      names=["place", "n", "sums", "mean", "vals", "vecs"])


def _combined(spectra: DataFrame) -> DataFrame:
    """Each ``FAN_IN`` neighbouring spectra as one."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        each = [Spectrum(int(r.n), r.mean_, r.vals, r.vecs.reshape(len(r.vals), -1))
                for r in rows.rename(columns={"mean": "mean_"}).itertuples()]
        s = reduce(Spectrum.combine, each)
        return pd.DataFrame({"place": [int(rows["place"].iloc[0]) // FAN_IN], "n": [s.n], "sums": [np.sum(np.stack(rows["sums"]), 0)],
                             "mean": [s.mean], "vals": [s.values], "vecs": [s.vectors.ravel()]})

    return spectra.groupBy((F.col("place") / FAN_IN).cast("long").alias("group")).applyInPandas(run, _SPECTRUM)


def incremental_spectrum(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, Spectrum] | None:
    """Rows, exact sums per dimension, and the spectrum of all rows; None without rows."""
    spectra = stage(_spectra(vectors, width), "spectra")
    while (top := spectra.agg(F.max("place")).first()[0]) is not None and (top >= 1 or spectra.count() > 1):
        spectra = stage(_combined(spectra), "spectra")
    found = spectra.first()
    if found is None:
        return None
    s = Spectrum(found["n"], *(np.array(found[k]) for k in ("mean", "vals")), np.array(found["vecs"]).reshape(width, -1))
    return found["n"], np.array(found["sums"], np.int64), s


def _sum_over_rows(vectors: DataFrame, fn, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``fn(batch of x)`` over all rows: summed in tasks, then by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += fn(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["t"])

    parts = vectors.select("c").mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("i", "t"))
    got = parts.groupBy("i").agg(F.sum("t").alias("t")).orderBy("i").toArrow()
    return got.column("t").to_numpy().reshape(shape) if got.num_rows else np.zeros(shape)


def rayleigh_ritz(vectors: DataFrame, n: int, sums: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and eigenvectors of the covariance, ``k`` of them, and its trace.

    ``start`` holds basis columns. A step multiplies the basis by the covariance in one pass over the rows, and takes
    the best vectors inside it; where the basis isn't complete it is repeated on the product until the residual is small.
    """
    basis = np.linalg.qr(start)[0]
    width, m = basis.shape
    mean = sums / n

    def products(x: np.ndarray, basis=basis) -> np.ndarray:
        centred = x - mean
        return np.concatenate((centred.T @ (centred @ basis), np.full((1, m), (centred * centred).sum() / m)))

    for _ in range(STEPS):
        got = _sum_over_rows(vectors, lambda x, b=basis: products(x, b), (width + 1, m)) / n
        product, trace = got[:-1], float(got[-1].sum())
        inside = basis.T @ product
        values, turn = np.linalg.eigh((inside + inside.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, product @ turn
        off = np.abs(moved[:, :k] - ritz[:, :k] * values[:k]).max() if trace else 0.0
        if m == width or off <= RESIDUAL * trace:
            break
        basis = np.linalg.qr(moved)[0]
    return values[:k], ritz[:, :k], trace


def whiten(rows: DataFrame, components: int = COMPONENTS, basis: int = BASIS, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    x = floor(1024 c) + 100000 for every entry c. Vectors that are null, or hold null or non-finite entries, are left
    out, as are empty ones and, of mixed lengths, all but the commonest. Repeated rows and rows without an id count and
    return like others. There are as many components as dimensions, up to ``components``. A component without variance
    (all rows equal, or fewer rows than components) has whitened 0, and takes no part in identity_error, which is null
    if none has variance. A deviation beyond a long is null. Without rows there is no result.
    """
    vectors = vectors_of(rows, vec_id, vector)
    first = vectors.select(F.size("c").alias("width")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    width = first["width"]
    n, sums, spectrum = incremental_spectrum(vectors, width)
    k = min(components, width)
    values, ritz, trace = rayleigh_ritz(vectors, n, sums, spectrum.vectors[:, ::-1][:, :min(width, max(basis, k))], k)
    ritz = ritz * np.where(np.take_along_axis(ritz, np.abs(ritz).argmax(0)[None], 0) < 0, -1.0, 1.0)
    real = values > 64 * EPS * width * max(trace, 0.0)
    turn = np.where(real, ritz / np.sqrt(np.where(real, values, 1.0)), 0.0)
    mean = sums / n

    def scatter(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ turn
        return np.concatenate((y.T @ y, y.sum(0)[None]))

    got = _sum_over_rows(vectors, scatter, (k + 1, k)) / n
    error = np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(k))[np.ix_(real, real)]
    identity_error = float(error.max()) if error.size else None
    explained = np.where(real, values / trace, 0.0) if trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            y = (x - mean) @ turn
            away = (x - mean) * n
            fits = (away * away).sum(1) < 9.2e18
            exact = n * x - sums
            squares = pa.array(np.where(fits, (exact * exact).sum(1), 0), mask=~fits)
            rows = len(x)
            again = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n)), squares.take(pa.array(again)), pa.array(y.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array([identity_error] * (rows * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "c").mapInArrow(run, schema)
