"""Sums along a series that start anew whenever a span of time is over.

Where the next sum starts depends on where this one did, so a series looks like
one long fold. It is cut into chunks of time here. Whatever happened before a
chunk, all that matters inside is the time from which the span is over; so a
chunk states for each row at which it may be entered where it would be left.
Folding these short statements of a series gives every chunk its real entry, and
the chunks make their sums independently: a long series is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.batches import by_group


def successors(times: np.ndarray, span: float) -> np.ndarray:
    """For each row the first one that is ``span`` or more later; the number of rows if there is none."""
    return np.searchsorted(times, times + span, side="left")


def chunk_statement(times: np.ndarray, values: np.ndarray, span: float, start: float) -> tuple:
    """What a chunk does to a walk that enters it: for each possible entry the row at which the walk leaves it."""
    after = successors(times, span)
    leaves = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            leaves[i] = leaves[after[i]]
    entries = min(len(times), max(1, int(np.searchsorted(times, start + span, side="left")) + 1))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    left = leaves[:entries]
    before_left = [float(sums[i - 1]) if i else None for i in left.tolist()]
    return times[:entries].tolist(), times[left].tolist(), left.tolist(), before_left, len(times), float(sums[-1]), float(sums[-2])


STATEMENT = "enter array<double>, leave array<double>, leave_row array<long>, leave_sum array<double>, n long, total double, but_last double"
ENTRY = "needed double, row0 long, sum0 double, before0 double, from_row long, from_sum double"


def entries_of(statements: list[tuple], span: float) -> Iterator[tuple]:
    """(chunk, needed, row0, sum0, before0, from_row, from_sum) of each chunk of one series, in order.

    needed: the time from which the span is over (null at the series' start).
    row0, sum0: rows and sum before the chunk; before0: that sum without its last
    value. from_row, from_sum: where the sum that is open began.
    """
    needed, row0, sum0, before0, from_row, from_sum = None, 0, 0.0, 0.0, 0, 0.0
    for chunk, enter, leave, leave_row, leave_sum, n, total, but_last in statements:
        yield chunk, needed, row0, sum0, before0, from_row, from_sum
        k = 0 if needed is None else int(np.searchsorted(enter, needed, side="left"))
        if k < len(enter):
            needed = leave[k] + span
            from_row = max(row0 + leave_row[k] - 1, 0)
            from_sum = before0 if leave_sum[k] is None else sum0 + leave_sum[k]
        row0, sum0, before0 = row0 + n, sum0 + total, sum0 + but_last


def chunk_resets(times: np.ndarray, values: np.ndarray, span: float, entry: tuple) -> Iterator[tuple[int, int, float, float]]:
    """(first row, last row, sum, time) of each sum that ends in a chunk; rows are counted from the series' start.

    A sum covers the rows from its first up to, without, its last.
    """
    needed, row0, sum0, before0, from_row, from_sum = entry
    before = np.concatenate([[before0], sum0 + np.concatenate([[0.0], np.cumsum(values)])[:-2]]) if len(values) > 1 else np.array([before0])
    if needed is None:
        i = int(np.searchsorted(times, times[0] + span, side="left"))
    else:
        i = int(np.searchsorted(times, needed, side="left"))
    after = successors(times, span)
    while i < len(times):
        yield from_row, row0 + i - 1, float(before[i] - from_sum), float(times[i])
        from_row, from_sum, i = row0 + i - 1, float(before[i]), int(after[i])


def resets(df: DataFrame, span: float, value: str, key: str = "bid", time: str = "time", chunk: float | None = None) -> DataFrame:
    """key, first, last, total, until: sums of ``value`` over a series' rows, in order of time, each of which ends when ``span`` seconds are over.

    first, last: numbers of rows (from 0); a sum covers first up to last - 1. until:
    the time of the row after last, from which the next span counts. The rest of
    a series that is shorter than the span has no row. Times of a series differ;
    rows with a null key, time or value are left out. chunk: seconds of a series
    that one task walks at a time (None: 64 spans).
    """
    chunk = max(chunk or 64 * span, span)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.floor(F.col(time) / chunk).cast("long").alias("chunk"), F.col(time).cast("double").alias("time"), F.col(value).cast("double").alias("value")).dropna()
    def state(k: tuple, group: list[tuple]) -> Iterator[tuple]:
        times, values = (np.array(v, dtype=float) for v in zip(*group))
        yield *k, *chunk_statement(times, values, span, k[1] * chunk)

    def fold(k: tuple, group: list[tuple]) -> Iterator[tuple]:
        return ((*k, *e) for e in entries_of(group, span))

    def walk(k: tuple, group: list[tuple]) -> Iterator[tuple]:
        times, values = (np.array([g[i] for g in group], dtype=float) for i in (0, 1))
        return ((k[0], *r) for r in chunk_resets(times, values, span, group[0][2:]))

    stated = by_group(rows, ["key", "chunk"], ["time"], state, f"key {kind}, chunk long, {STATEMENT}")
    entered = by_group(stated, ["key"], ["chunk"], fold, f"key {kind}, chunk long, {ENTRY}")
    walked = by_group(rows.join(entered, ["key", "chunk"]), ["key", "chunk"], ["time"], walk, f"key {kind}, first long, last long, total double, until double")
    return walked.withColumnRenamed("key", key)


def turn_count(found: DataFrame, least: float, key: str = "bid") -> DataFrame:
    """key, sums, turns: how many sums (of ``resets``) there are, and how many of at least ``least``."""
    return found.groupBy(key).agg(F.count("*").alias("sums"), F.count_if(F.col("total") >= least).alias("turns"))


def turn_middles(found: DataFrame, points: DataFrame, least: float, key: str = "bid", order: str = "frame") -> DataFrame:
    """key, middle, total and the other columns of the point in the middle of each sum of at least ``least``; points are numbered from 0."""
    middles = found.where(F.col("total") >= least).select(key, F.floor((F.col("first") + F.col("last")) / 2).alias("middle"), "total")
    return middles.join(points.withColumnRenamed(order, "middle"), [key, "middle"])


def signed_turns(df: DataFrame, key: str = "bid", order: str = "frame", time: str = "time") -> DataFrame:
    """key, time, turn: the signed angle in degrees between the steps to and from each row, at the mean of their mid-times; 0 where a step has no length."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = {c: F.lag(c).over(w) for c in ("x", "y", time)}, {c: F.lead(c).over(w) for c in ("x", "y", time)}
    ax, ay, bx, by = F.col("x") - back["x"], F.col("y") - back["y"], ahead["x"] - F.col("x"), ahead["y"] - F.col("y")
    moved = ((ax != 0) | (ay != 0)) & ((bx != 0) | (by != 0))
    mid = (back[time] + 2 * F.col(time) + ahead[time]) / 4
    angle = F.degrees(F.atan2(ax * by - ay * bx + 0.0, ax * bx + ay * by))
    return df.select(key, F.col(order), mid.alias(time), F.when(moved, angle).otherwise(0.0).alias("turn")).where(F.col(time).isNotNull())
