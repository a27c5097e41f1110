"""Operator 12 - embedding whitening by mixed-precision refinement.

Components c become whole numbers floor(64 c) + 1000000. The different vectors
among them are the fit list: Spark gives their sums exactly, and then the sums of
products of what is centred on the mean. Only sums leave the tasks, d + d * d
numbers for vectors of d components.

The eigenvectors of that covariance are found in single precision and then
corrected: an Ogita-Aishima step makes the matrix X of eigenvectors both more
orthogonal and more diagonal with products of matrices alone, in extended
precision, and doubles the number of right digits. Where eigenvalues are closer
than a step can tell apart, it makes their vectors orthonormal; such a cluster is
then solved for itself: the covariance, less the cluster's mean eigenvalue, is
brought into the space that the cluster spans, where the differences are no
longer small against the values, and turned by the eigenvectors of that.

Rows are then projected in one pass, and a last pass over the fit list measures
how far the covariance of the whitened vectors is from the identity.

Defined cases: rows whose vector is null, or holds null or non-finite entries or
one of 2**40 or more (its whole number would not be exact), are dropped; vectors
of different lengths are fitted apart, each length by itself; empty vectors have
no components and no rows; components without variance (below ``FLAT`` of the
trace) can't be whitened and are left out, so that a table whose vectors are all
equal has no rows; equal eigenvalues span a space in which any base is right; a
deviation that passes a long is null; repeated rows and null ids keep their rows;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE, ADDED, COMPONENTS = 64, 1_000_000, 16
LARGEST = 2.0**40
#: A variance below this part of the trace is none.
FLAT = 1e-11
#: Vectors that a task multiplies at once, and refinement steps at most.
ROWS, STEPS = 4096, 24
Wide, DOUBLE = np.longdouble, float(np.finfo(np.float64).eps)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


@dataclass(frozen=True)
class Centre:
    """The mean of n vectors as whole part and rest, so that differences from it lose nothing."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once."""
        return (x - self.whole).astype(np.float64) - (self.rest.astype(Wide) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - sums)**2 of each row, exact; None where it passes a long."""
        near = x - self.whole
        most = int(np.abs(near).max(initial=0)) + 1
        if (self.n * most) ** 2 * max(1, x.shape[1]) < 1 << 63:
            d = near * self.n - self.rest
            return (d * d).sum(axis=1).tolist()
        d = near.astype(object) * self.n - self.rest.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the sum of every place: (place, high, low), high in units of 2**20, so that neither passes a long."""
    total = None
    for batch in _slices(batches):
        if batch.num_rows:
            x = _matrix(batch.column(0))
            own = np.stack([(x >> 20).sum(axis=0), (x & (1 << 20) - 1).sum(axis=0)])
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(total.shape[1]), *total)], ["i", "high", "low"])


def _products(centre: Centre, turn: np.ndarray | None = None):
    """Per task the sums of products of centred vectors (or of these times ``turn``), upper triangle: (i, j, total)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            if batch.num_rows:
                d = centre.off(_matrix(batch.column(0)))
                d = d if turn is None else d @ turn
                total = d.T @ d if total is None else total + d.T @ d
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "total"])

    return multiply


def covariance(fit: DataFrame, centre: Centre, turn: np.ndarray | None = None) -> np.ndarray:
    """Of the vectors ``x`` of the fit list, or of these times ``turn``; divisor n."""
    sums = fit.select("x").mapInArrow(_products(centre, turn), "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toPandas()
    size = len(centre.sums) if turn is None else turn.shape[1]
    out = np.zeros((size, size))
    i, j, v = (sums[c].to_numpy() for c in ("i", "j", "total"))
    out[i, j] = out[j, i] = v / centre.n
    return out


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: better eigenvectors, their eigenvalues, what can't be told apart, and the largest correction."""
    eye = np.eye(x.shape[1], dtype=Wide)
    r, s = eye - x.T @ x, x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.sqrt((m * m).sum()))
    # Closer than the digits of the matrix itself can tell: any base of their space is right.
    blur = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r)) + 4 * DOUBLE * norm(a)
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > blur
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    return x + x @ e, values, blur, float(np.abs(e).max(initial=0))


def _clusters(values: np.ndarray, blur: float) -> list[np.ndarray]:
    """Places of eigenvalues that neighbours can't be told from, in groups of two or more."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > blur) + 1
    return [group for group in np.split(order, cut) if len(group) > 1]


def _orthonormal(x: np.ndarray, times: int) -> np.ndarray:
    """Nearly orthonormal columns made so; each time doubles the right digits."""
    for _ in range(times):
        x = x @ (1.5 * np.eye(x.shape[1], dtype=Wide) - x.T @ x / 2)
    return x


def _turned(a: np.ndarray, x: np.ndarray, values: np.ndarray, group: np.ndarray, least: float) -> np.ndarray:
    """The vectors of a cluster, turned by the eigenvectors of what the covariance does beyond its mean there."""
    own = x[:, group]
    inner = own.T @ (a @ own) - values[group].mean() * (own.T @ own)
    size = float(np.abs(inner).max(initial=0))
    if size <= least:
        return own
    _, turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float32))
    return own @ _orthonormal(turn.astype(Wide), 2)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix to double precision.

    Single precision first; then steps in extended precision, each followed by sub-solves of the
    clusters that it leaves, until corrections are below double precision and the clusters with them.
    """
    a = matrix.astype(Wide)
    scale = float(np.abs(matrix).max(initial=0)) or 1.0
    _, start = np.linalg.eigh((matrix / scale).astype(np.float32))
    x, change, values = start.astype(Wide), np.inf, np.zeros(len(matrix), Wide)
    for _ in range(STEPS):
        x, values, blur, change = _step(a, x)
        groups = _clusters(values, blur)
        for group in groups:
            x[:, group] = _turned(a, x, values, group, 4 * DOUBLE * scale)
        if change < DOUBLE / 8:
            break
    x = _orthonormal(x, 1)
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def _whitened_rows(centre: Centre, turn: np.ndarray, explained: np.ndarray, error: float):
    k = turn.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, m = _matrix(batch.column("x")), batch.num_rows
            if not m:
                continue
            owner = np.repeat(np.arange(m), k)
            deviation = pa.array(centre.deviation(x), pa.int64())
            columns = [
                batch.column("id").take(pa.array(owner)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)), deviation.take(pa.array(owner)),
                pa.array((centre.off(x) @ turn).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``key``, component, n, deviation, whitened, explained and identity_error."""
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size("v") > 0), F.lit(False))
    whole = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(ADDED).cast("long"))
    rows = rows.where(sound).select("id", whole.alias("x"), F.size("v").alias("d"))
    fit_all = written(rows.select("x", "d").distinct(), "whitening-fit")
    results = []
    # One row per length of vector.
    for d, n in sorted(fit_all.groupBy("d").count().collect()):
        fit = fit_all.where(F.col("d") == d)
        sums = fit.select("x").mapInArrow(_sums, "i long, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
        centre = Centre(n, tuple((r["high"] << 20) + r["low"] for r in sums))
        v = covariance(fit, centre)
        values, vectors = eigen(v)
        trace = float(np.trace(v))
        used = int((values[:components] > FLAT * trace).sum())
        if used:
            turn = vectors[:, :used] / np.sqrt(values[:used])
            error = float(np.abs(covariance(fit, centre, turn) - np.eye(used)).max())
            own = rows.where(F.col("d") == d).select("id", "x")
            results.append(own.mapInArrow(_whitened_rows(centre, turn, values[:used] / trace, error), schema))
    found = reduce(DataFrame.unionByName, results) if results else df.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("id", key)
