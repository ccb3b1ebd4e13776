"""Rows of Arrow batches inside tasks: groups of sorted rows one at a time, folds, and batches of result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 20_000


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches sorted by key, one group in memory at a time."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in (*keys, *rest)]):
            if at != row[: len(keys)]:
                if rows:
                    yield at, rows
                at, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield at, rows


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(key, rows) of batches sorted by key, as ``groups_of``, but the rows stay Arrow columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for k in [*(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]:
            if held and start == 0 and held[0].column(key)[0].as_py() != keys[0]:
                yield held[0].column(key)[0].as_py(), pa.concat_batches(held)
                held = []
            if k < len(keys):
                own = batch.slice(start, k - start)
                yield keys[start], pa.concat_batches([*held, own]) if held else own
                held = []
            elif k > start:
                held.append(batch.slice(start))
            start = k
    if held:
        yield held[0].column(key)[0].as_py(), pa.concat_batches(held)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key in one of the session's number of partitions; few bytes may be much work, so small ones aren't joined."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_tasks(df: DataFrame, rows: int, most: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in tasks of about ``most`` of its ``rows`` each, however few bytes they have: what is made of them may be far more.

    Windows, groups and joins on these keys and others need no further shuffle.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, -(-rows // most), min(usual, 8 * rows // most)), *keys)


def by_group(df: DataFrame, keys: list[str], order: list[str], each: Callable[[tuple, list[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """The result rows of ``each(key, rows)``, rows being tuples of the other columns in order; many groups share a task."""
    schema, rest = arrow_schema(ddl), [c for c in df.columns if c not in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in groups_of(batches, keys, rest):
            out.extend(each(key, rows))
            if len(out) >= ROWS:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    return dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def along_sorted(df: DataFrame, keys: list[str], order: list[str], new_state: Callable[[tuple], Callable[[tuple], Iterable[tuple]]], ddl: str) -> DataFrame:
    """A fold over each key's rows in order: ``new_state(key)`` gives a function that yields result rows for each row of the other columns.

    A task keeps one state and no rows, so a key may have any number of them.
    """
    schema, rest = arrow_schema(ddl), [c for c in df.columns if c not in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, n = None, None, len(keys)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, *rest)]):
                if step is None or row[:n] != at:
                    at, step = row[:n], new_state(row[:n])
                out.extend(step(row[n:]))
            if out:
                yield batch_of(out, schema)

    return dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)
