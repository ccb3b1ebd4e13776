"""Embedding whitening by a two-pass covariance.

Vectors become integers; the distinct ones are the fit list. A first pass sums
them exactly, which gives the mean; a second one sums the outer products of
centred rows, a matrix product a batch and one matrix a task, merged by
treeAggregate. The driver takes the eigenvectors of that d x d matrix; the
projection, d x components, is broadcast to all rows. Nothing but matrices whose
size depends on the dimension reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.textbytes import give_back
from trackloom.llm.vectors import as_doubles, integer_rows, main_dimension, matrices, split_sums
from trackloom.plans.lineage import stored


@dataclass(frozen=True)
class Whitening:
    """n, sums: number and exact sums of the fit list. components: unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def _distinct(dimension: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integer_rows(batch.column("vec"), dimension)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array({r.tobytes() for r in x.astype("<i8")}, pa.binary())], ["x"])

    return run


def _sums(dimension: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for x in matrices(batches, "x", dimension):
            n, sums = n + len(x), [a + b for a, b in zip(sums, split_sums(x))]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]]})

    return run


def _products(dimension: int, mean: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for x in matrices(batches, "x", dimension):
            centred = x - mean
            total += centred.T @ centred
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    return run


def _spread(dimension: int, mean: np.ndarray, projection: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for x in matrices(batches, "x", dimension):
            found = merged(found, moments((x - mean) @ projection))
        if found:
            yield pa.RecordBatch.from_pydict({"n": [found[0]], "mean": [found[1].tobytes()], "m": [found[2].tobytes()]})

    return run


def moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred products of rows."""
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """The moments of two sets of rows together; None is no rows."""
    if a is None or b is None:
        return b if a is None else a
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def fit_whitening(df: DataFrame, vec_col: str = "embedding", components: int | None = None) -> Whitening | None:
    """The whitening of the distinct integer vectors of ``df``; None if there are none.

    Rows with a null vector, a null or non-finite entry or one of 2**44 or more
    are left out, and so are vectors of another length than most. Components of
    which the eigenvalue is zero (but for rounding) don't exist: equal vectors
    only, or one, have none. components: how many at most (None: all).
    """
    d = main_dimension(df, vec_col)
    if not d:
        return None
    fit = df.select(as_doubles(vec_col).alias("vec")).where("vec is not null").mapInArrow(_distinct(d), "x binary").distinct()
    fit = stored(fit, "fit-list")
    n, sums = fit.mapInArrow(_sums(d), "n long, sums array<string>").rdd.treeAggregate(
        (0, [0] * d), lambda a, r: (a[0] + r["n"], [x + int(y) for x, y in zip(a[1], r["sums"])]), lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])])
    )
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    products = fit.mapInArrow(_products(d, mean), "m binary").rdd.treeAggregate(np.zeros((d, d)), lambda a, r: a + np.frombuffer(r["m"]).reshape(d, d), lambda a, b: a + b)
    covariance = products / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values > max(values[0], 0) * d * np.finfo(float).eps).sum())
    k = k if components is None else min(k, components)
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    error = 0.0
    if k:
        rows = fit.mapInArrow(_spread(d, mean, vectors / np.sqrt(values)), "n long, mean binary, m binary").rdd
        found = rows.treeAggregate(None, lambda a, r: merged(a, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m"]).reshape(k, k))), merged)
        error = float(np.abs(found[2] / n - np.eye(k)).max())
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(covariance)), error)


def squared_lengths(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sum over the columns of (n * x - sum)**2 of each row, from three 21-bit parts of the difference where it fits 63 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most >= 2**63:
        wide = x.astype(object) * n - np.array(sums, dtype=object)
        return [int(v) for v in (wide * wide).sum(axis=1)]
    y = x * np.int64(n) - np.array(sums, dtype=np.int64)
    a, b, c = y >> 42, (y >> 21) & (2**21 - 1), y & (2**21 - 1)
    terms = [(u * v).sum(axis=1).tolist() for u, v in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
    return [(aa << 84) + (ab << 64) + ((2 * ac + bb) << 42) + (bc << 22) + cc for aa, ab, ac, bb, bc, cc in zip(*terms)]


def whiten(df: DataFrame, model: Whitening | None, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """id, whitened, deviation for each row of ``df`` whose vector has the model's length and finite entries.

    whitened: array<double>, an entry a component. deviation: decimal(38, 0), the
    sum over the dimensions of (n * x - S)**2, null if it has more digits. A null
    id is kept; without a model there are no rows; extra columns are ignored.
    """
    d = len(model.sums) if model else 0
    shared = df.sparkSession.sparkContext.broadcast((model, model.mean, model.projection) if model else None)
    rows = df.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("row"), as_doubles(vec_col).alias("vec"))
    if not model:
        rows = rows.where("false")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fitted, mean, projection = shared.value
            places, x = integer_rows(batch.column("vec"), d)
            lengths = pa.array([v if v < 10**38 else None for v in squared_lengths(x, fitted.n, fitted.sums)], pa.decimal128(38, 0))
            flat = ((x - mean) @ projection).ravel()
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * projection.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(places)), pa.ListArray.from_arrays(offsets, pa.array(flat)), lengths], ["row", "whitened", "deviation"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row struct<id:{kind}>, whitened array<double>, deviation decimal(38,0)").select(F.col("row.id").alias(id_col), "whitened", "deviation")
