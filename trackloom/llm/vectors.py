"""Rows of vectors as integer matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries from this on are dropped like those that aren't finite: integers up to here are exact as doubles.
TOO_LARGE = 2.0**52


def as_doubles(name: str) -> Column:
    return F.col(f"`{name}`").cast("array<double>")


def main_dimension(df: DataFrame, vec_col: str) -> int:
    """The length that most vectors have (of equally many, the largest); 0 if there is none."""
    sizes = df.select(F.size(f"`{vec_col}`").alias("d")).where("d > 0").groupBy("d").count()
    found = sizes.orderBy(F.desc("count"), F.desc("d")).head()
    return found["d"] if found else 0


def integer_rows(column: pa.Array, dimension: int, scale: float = 256.0) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): floor(scale * entry) of the vectors of that length without null, infinite or too large entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    offsets = column.offsets.to_numpy()
    fits = (np.diff(offsets) == dimension) & column.is_valid().to_numpy(zero_copy_only=False)
    places = np.flatnonzero(fits)
    if not dimension or not len(places):
        return places[:0], np.zeros((0, dimension), dtype=np.int64)
    x = np.floor(scale * flat[offsets[places][:, None] + np.arange(dimension)])
    good = (np.abs(x) < TOO_LARGE).all(axis=1)
    return places[good], x[good].astype(np.int64)


def split_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns: of the upper and the lower 26 bits, neither of which overflows."""
    high = (x >> 26).sum(axis=0)
    low = (x & (2**26 - 1)).sum(axis=0)
    return [(int(h) << 26) + int(k) for h, k in zip(high, low)]


def matrices(batches: Iterator[pa.RecordBatch], column: str, dimension: int) -> Iterator[np.ndarray]:
    """The stored little-endian 64-bit integers of each batch as a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype="<i8").reshape(-1, dimension)
