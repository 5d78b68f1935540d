"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of its own scatter
matrix and updates them for every row by a centred rank-one update: the new
eigenvalues are the roots of a secular equation between the old ones, after
deflation of equal eigenvalues and of directions that the row does not touch.
Partitions' spectra are combined in a tree, again by rank-one updates: one for
each eigenpair of the other side and one for the difference of the means.  The
result is a basis; a distributed Rayleigh-Ritz step over all rows, with the
exact mean, gives the eigenpairs to double precision.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import input_partitions
from barloom.llm.vectors import finite_rows, merged, whole

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
EPS = np.finfo(float).eps
#: Components with less than this share of the largest eigenvalue have no variance to divide by.
FLAT = 1e-13


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for ascending d: each as the nearest pole's place and the distance from it.

    Each root lies between a pole and the next (the last: within sum(z2) of
    it).  The sums over the poles below and above are replaced by one pole each
    with the same value and slope, which gives a quadratic equation; a bracket
    guards each step.
    """
    m = len(d)
    rows = np.arange(m)
    end = np.append(d[1:], d[-1] + z2.sum())
    gap = end - d
    apart = d[None, :] - d[:, None]
    middle = 1 + (z2 / (apart - gap[:, None] / 2)).sum(1)
    near = np.where((middle >= 0) | (rows == m - 1), rows, rows + 1)
    left = near == rows
    poles = d[None, :] - d[near][:, None]
    half = gap / 2
    low = np.where(left, 0.0, -half)
    high = np.where(left, half, 0.0)
    if middle[-1] < 0:
        low[-1], high[-1] = half[-1], gap[-1] * (1 + 4 * EPS)
    x = (low + high) / 2
    below = np.tri(m)
    above = 1 - below
    next_pole = np.minimum(rows + 1, m - 1)
    for _ in range(80):
        far = poles - x[:, None]
        term = z2 / far
        slope = term / far
        lower, upper, lower_slope, upper_slope = (np.einsum("ij,ij->i", t, side) for t in (term, slope) for side in (below, above))
        f = 1 + lower + upper
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        d1, d2 = far[rows, rows], far[rows, next_pole]
        c = 1 + lower - lower_slope * d1 + upper - upper_slope * d2
        a = c * (d1 + d2) + lower_slope * d1**2 + upper_slope * d2**2
        b = d1 * d2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            c_last = 1 + lower[-1] - lower_slope[-1] * d1[-1]
            step[-1] = d1[-1] + lower_slope[-1] * d1[-1] ** 2 / c_last if c_last > 0 else np.nan
        # a value of f within its own rounding error, or a step within that of the root, ends the search
        done = (np.abs(f) <= 4 * EPS * (1 + upper - lower)) | (np.abs(step) <= 4 * EPS * np.abs(x))
        new = x + step
        out = ~((new > low) & (new < high))
        new[out] = (low[out] + high[out]) / 2
        x = np.where(done, x, new)
        if (done | (high - low <= 4 * EPS * np.abs(x))).all():
            break
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of vectors @ diag(values) @ vectors.T + outer(v, v)."""
    z = vectors.T @ v
    size = float(z @ z)
    if size == 0:
        return values, vectors
    tiny = 8 * EPS * max(float(values[-1]), size)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(values) > tiny]))
    ends = np.append(starts[1:], len(values))
    if len(starts) < len(values):
        vectors = vectors.copy()
        # equal eigenvalues: a reflection of their vectors leaves the row in one direction of them
        for s, e in zip(starts, ends, strict=True):
            length = math.sqrt(float(z[s:e] @ z[s:e])) if e - s > 1 else 0
            if length:
                u = z[s:e].copy()
                sign = math.copysign(length, u[-1])
                u[-1] += sign
                u /= np.linalg.norm(u)
                vectors[:, s:e] -= 2 * np.outer(vectors[:, s:e] @ u, u)
                z[s:e] = 0
                z[e - 1] = -sign
    live = np.flatnonzero(np.abs(z) * math.sqrt(size) > tiny)
    d, own = values[live], z[live]
    if not len(live):
        return values, vectors
    near, x = secular_roots(d, own * own)
    # distances root - pole without cancellation; the entries of the row are taken anew from them, which keeps the vectors orthogonal
    away = (d[near] + 0.0)[:, None] - d[None, :] + x[:, None]
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1)
    with np.errstate(divide="ignore"):
        logs = np.log(np.abs(away)).sum(0) - np.log(np.abs(between)).sum(1)
    exact = np.copysign(np.exp(logs / 2), own)
    turn = exact[None, :] / away
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    new_values = values.copy()
    new_values[live] = d[near] + x
    new_vectors = vectors.copy()
    new_vectors[:, live] = vectors[:, live] @ turn.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Number, exact sums and mean of some rows, and the eigenpairs of their scatter matrix."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, [0] * size, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away * math.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def join(self, other: Spectrum) -> Spectrum:
        if len(self.sums) != len(other.sums):
            raise ValueError("vectors of different lengths")
        values, vectors, n = self.values, self.vectors, self.n + other.n
        for size, direction in zip(other.values, other.vectors.T, strict=True):
            if size > 0:
                values, vectors = rank_one(values, vectors, math.sqrt(size) * direction)
        values, vectors = rank_one(values, vectors, math.sqrt(self.n * other.n / n) * (other.mean - self.mean))
        mean = self.mean + (other.mean - self.mean) * (other.n / n)
        return Spectrum(n, [x + y for x, y in zip(self.sums, other.sums, strict=True)], mean, values, vectors)


@dataclass
class Whitening:
    """Number and sums of the fit list, and up to COMPONENTS eigenpairs of its covariance, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def mean(self) -> np.ndarray:
        return np.asarray([s / self.n for s in self.sums])

    def map(self) -> np.ndarray:
        """Columns that project a centred row to unit variance; not a number where there is none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > FLAT * max(self.trace, 1e-300), self.vectors / np.sqrt(self.values), np.nan)


def _part() -> int:
    return TaskContext.get().partitionId()


def _one(state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])


_STATE = "part long, state binary"


def spectra(rows: DataFrame) -> DataFrame:
    """The spectrum of each partition's vectors (column 0), one row a partition that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for _, matrix in finite_rows(batch.column(0)):
                if not len(matrix):
                    continue
                x = whole(matrix, SCALE)
                own = own or Spectrum.empty(x.shape[1])
                if x.shape[1] != len(own.sums):
                    raise ValueError("vectors of different lengths")
                for row in x.astype(float):
                    own.add(row)
                own.sums = [s + int(t) + OFFSET * len(x) for s, t in zip(own.sums, x.sum(0), strict=True)]
        if own is not None:
            yield _one(own)

    return rows.mapInArrow(run, _STATE)


def projected_scatter(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """Of each partition (number, mean, scatter) of its centred rows in the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for _, matrix in finite_rows(batch.column(0)):
                if len(matrix):
                    y = (whole(matrix, SCALE, OFFSET) - mean) @ basis
                    middle = y.mean(0)
                    part = (len(y), middle, (y - middle).T @ (y - middle))
                    own = part if own is None else add_moments(own, part)
        if own is not None:
            yield _one(own)

    return rows.mapInArrow(run, _STATE)


def add_moments(x: tuple, y: tuple) -> tuple:
    """Number, mean and scatter of two lists together."""
    n, away = x[0] + y[0], y[1] - x[1]
    return n, x[1] + away * (y[0] / n), x[2] + y[2] + np.outer(away, away) * (x[0] * y[0] / n)


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all finite vectors; None if there is none.

    Three passes: spectra of the partitions, Rayleigh-Ritz in their combined
    basis, and the covariance of the whitened rows.  What goes to the driver is
    one matrix of the vectors' length squared, whatever the number of rows.
    """
    rows = vectors.select(F.col(vector_col).alias("v"))
    # an update costs far more than its row's bytes, so rows are dealt over all tasks
    dealt = rows.repartition(input_partitions(vectors.sparkSession))
    found = merged(spectra(dealt), lambda x, y: x.join(y), "spectra")
    if found is None:
        return None
    model = Whitening(found.n, found.sums, found.values, found.vectors, 0.0)
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    n, middle, scatter = merged(projected_scatter(rows, model.mean(), basis), add_moments, "projected")
    covariance = scatter / n
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = min(components, len(values))
    model.values, model.vectors = np.maximum(values[::-1][:kept], 0), (basis @ turn)[:, ::-1][:, :kept]
    model.trace = float(np.trace(covariance))
    projection = model.map()
    good = np.flatnonzero(np.isfinite(projection).all(0))
    if len(good):
        n, _, scatter = merged(projected_scatter(rows, model.mean(), projection[:, good]), add_moments, "whitened")
        model.identity_error = float(np.abs(scatter / n - np.eye(len(good))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array) of each finite vector; whitened entries are null where the component has no variance.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out; repeated rows and null ids stay.  Vectors of another length than
    the model's raise, and so does a deviation beyond a long.
    """
    schema = T.StructType([T.StructField("vec_id", vectors.schema[id_col].dataType)]).add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, projection, n, sums = model.mean(), model.map(), model.n, np.asarray(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, matrix in finite_rows(batch.column(1)):
                if not len(places):
                    continue
                x = whole(matrix, SCALE, OFFSET)
                largest = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
                if largest < 1 << 62 and (away := n * x - sums.astype(np.int64)[None, :]) is not None and int(np.abs(away).max()) ** 2 * x.shape[1] < 1 << 63:
                    deviation = (away * away).sum(1)
                else:
                    deviation = [sum(int(e) ** 2 for e in row) for row in n * x.astype(object) - sums[None, :]]
                y = (x - mean) @ projection
                flat = pa.array(y.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each finite vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors shorter than ``components`` have as many as entries.  Where all
    rows are equal nothing is explained: whitened, explained and identity_error
    are null.  Empty tables, or without a finite vector, give no rows.
    """
    model = fit(vectors, components, vector_col)
    rows = whiten(vectors, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(v / model.trace) for v in model.values] if model is not None and model.trace > 0 else []
    explained = F.get(F.array(*[F.lit(s) for s in shares]), F.col("at")) if shares else F.lit(None).cast("double")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model is not None else 0).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error if model is not None else None).cast("double").alias("identity_error"),
    )
