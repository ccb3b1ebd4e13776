"""Curves as rows (keys, place, x, y): equal spacing, smoothing along, around and in time, and which end leads.

Everything is windows over a curve's rows; a curve may be as long as it likes.
Place is an integer that orders a curve's points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import FIRST_CHARACTER
from trackloom.operators.batches import along_sorted, arrow_schema
from trackloom.operators.models import savgol
from trackloom.operators.series import interpolate_grid
from trackloom.plans.lineage import cut


def spaced(df: DataFrame, n: int | None = None, keys: tuple[str, ...] = ("bid",), place: str = "place") -> DataFrame:
    """keys, place (from 0), x, y: ``n`` points (None: as many as the curve has) at equal distances along each curve.

    The length so far, in units of the wanted step, tells each segment which
    targets lie on it: a segment makes its own points, and nothing is searched.
    Curves without length have no steps and are left out.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    run = df.withColumn("_step", step).withColumn("_run", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = F.count(F.lit(1)).over(whole) - 1 if n is None else F.lit(n - 1)
    at = run.withColumns({"_total": F.last("_run").over(whole), "_steps": steps}).where("_total > 0")
    at = at.withColumn("_at", F.col("_run") / F.col("_total") * F.col("_steps"))
    pairs = at.select(*keys, "x", "y", "_at", F.lag("_at").over(w).alias("_before"), F.lag("x").over(w).alias("_x"), F.lag("y").over(w).alias("_y"))
    low = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.floor("_before") + 1)
    made = pairs.withColumn("_low", low).withColumn("_high", F.floor("_at")).where("_low <= _high").withColumn("place", F.explode(F.sequence("_low", "_high")))
    part = F.coalesce((F.col("place") - F.col("_before")) / (F.col("_at") - F.col("_before")), F.lit(1.0))
    value = lambda c: F.when(F.col("_before").isNull(), F.col(c)).otherwise(F.col(f"_{c}") + part * (F.col(c) - F.col(f"_{c}")))
    return made.select(*keys, F.col("place").alias(place), value("x").alias("x"), value("y").alias("y"))


def _moves(code: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y after each of the first ``n`` steps of an outline code, from 0."""
    v = np.frombuffer(code.encode("utf-32-le"), np.uint32)[: max(0, -(-n // 3))].astype(np.int64) - FIRST_CHARACTER
    s = (v[:, None] >> np.array([4, 2, 0]) & 3).ravel()[: max(0, n)]
    return np.cumsum(np.array([-1, 1, 0, 0])[s]), np.cumsum(np.array([0, 0, -1, 1])[s])


def _whole_codes(df: DataFrame, key: str, x: str, y: str, n: str, code: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(n).cast("long").alias("n"), F.col(code).alias("code"))
    return rows.dropna(subset=["x", "y", "n", "code"])


def outline_points(df: DataFrame, key: str, x: str = "x", y: str = "y", n: str = "n", code: str = "code") -> DataFrame:
    """key, place, x, y: the points of outline codes as rows, the start (place 0) and one for each of the first n steps.

    A code's points are made where the code is, some codes at a time, and not
    shuffled. Codes with a null part have no rows.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, place int, x long, y long"
    form = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (x0, y0, m, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("x", "y", "n", "code")])):
                dx, dy = (np.append(0, d) for d in _moves(text, m))
                same = batch.column("key").take(pa.array(np.full(len(dx), i)))
                yield pa.RecordBatch.from_arrays([same, pa.array(np.arange(len(dx), dtype=np.int32)), pa.array(x0 + dx), pa.array(y0 + dy)], schema=form)

    return _whole_codes(df, key, x, y, n, code).mapInArrow(run, schema)


def outline_extents(df: DataFrame, key: str, x: str = "x", y: str = "y", n: str = "n", code: str = "code") -> DataFrame:
    """key, steps, x, y (the last point) and bounds of outline codes; codes with a null part have no row."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, steps int, x int, y int, x_min int, x_max int, y_min int, y_max int"
    form = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x0, y0, m, text in zip(*[batch.column(c).to_pylist() for c in ("x", "y", "n", "code")]):
                px, py = (np.append(0, d) for d in _moves(text, m))
                out.append((len(px) - 1, x0 + int(px[-1]), y0 + int(py[-1]), x0 + int(px.min()), x0 + int(px.max()), y0 + int(py.min()), y0 + int(py.max())))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, f.type) for c, f in zip(zip(*out), list(form)[1:])]], schema=form)

    return _whole_codes(df, key, x, y, n, code).mapInArrow(run, schema)


def smoothed(df: DataFrame, width: int, order: int, keys: tuple[str, ...] = ("bid",), by: str = "place") -> DataFrame:
    """x, y by a Savitzky-Golay filter of ``width`` rows along ``by`` within ``keys``."""
    for c in ("x", "y"):
        df = savgol(df, c, width, order, keys, by).drop(c).withColumnRenamed("smooth", c)
    return df


def smooth_line(v: np.ndarray, weights: list[float]) -> np.ndarray:
    """``smoothed`` for a whole line of more than half as many values as weights: the same sums in the same order."""
    half = len(weights) // 2
    padded = np.concatenate([v[0] - np.abs(v[half:0:-1] - v[0]), v, v[-1] + np.abs(v[-2 : -half - 2 : -1] - v[-1])])
    total = np.zeros(len(v))
    for k, c in enumerate(weights):
        total = total + c * padded[k : k + len(v)]
    return total


def spaced_line(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``spaced`` for a whole line; None if it has no length."""
    run = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    if not run[-1] > 0:
        return None
    at, place = run / run[-1] * (n - 1), np.arange(1, n)
    i = np.searchsorted(at, place, "left")
    part = (place - at[i - 1]) / (at[i] - at[i - 1])
    return tuple(np.append(v[0], v[i - 1] + part * (v[i] - v[i - 1])) for v in (x, y))


def smoothed_around(df: DataFrame, width: int, order: int, keys: tuple[str, ...] = ("bid",), place: str = "place", around: int = 3) -> DataFrame:
    """A closed curve (places 0 to n - 1) smoothed; place n is the first point again.

    ``around`` points of the other end go before the first and after the last
    point; what a wider filter needs beyond them is reflected as at any end. A
    curve of fewer points than that is left out.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("_points", n).where(F.col("_points") >= around)
    turns = F.filter(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: (F.col(place) + k * F.col("_points") >= -around) & (F.col(place) + k * F.col("_points") < F.col("_points") + around))
    padded = rows.withColumn("_turn", F.explode(turns)).withColumn(place, F.col(place) + F.col("_turn") * F.col("_points")).drop("_turn")
    return smoothed(padded, width, order, keys, place).where((F.col(place) >= 0) & (F.col(place) <= F.col("_points"))).drop("_points")


def smoothed_in_time(df: DataFrame, space: tuple[int, int], time: tuple[int, int], step: float = 0.1, rounds: int = 5, keys: tuple[str, ...] = ("bid",), when: str = "time") -> DataFrame:
    """keys, tick, place, x, y: curves over time on the grid of multiples of ``step``.

    Each point is smoothed in time, each curve along itself and spaced equally;
    then the times are filled, and the three steps are taken ``rounds`` times
    more. space, time: widths and orders. Curves of one key have equally many points.
    """

    def once(rows: DataFrame, at: str) -> DataFrame:
        rows = smoothed(rows, *time, (*keys, "place"), at)
        return cut(spaced(smoothed(rows, *space, (*keys, at), "place"), None, (*keys, at)))

    rows = once(df.select(*keys, when, "place", "x", "y"), when).withColumn("_curve", F.struct(*keys, "place"))
    rows = interpolate_grid(rows, step, ["x", "y"], "_curve", when).select("_curve.*", "tick", "x", "y")
    for _ in range(rounds):
        rows = once(rows, "tick")
    return rows.select(*keys, "tick", "place", "x", "y")


def kept_direction(df: DataFrame, first: Column, last: Column, keys: tuple[str, ...] = ("bid",), by: str = "frame") -> DataFrame:
    """turned: is a curve (a row with its end points, structs of x and y) to be read backwards to face like the one before?

    It is where its last point is nearer than its first to where the one before
    begins, as that one is read. From one curve to the next this is one of four
    functions of "is the one before turned": keep, swap, always, never. What
    holds at a row follows from the last row that settles it and the number of
    swaps since: two running values, no fold. Curves without points (null ends)
    aren't turned, nor is what follows them.
    """
    w = Window.partitionBy(*keys).orderBy(by)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    away = lambda p, q: (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)
    rows = df.withColumns({"_first": first, "_last": last})
    begun, ended = F.lag("_first").over(w), F.lag("_last").over(w)
    straight = away(begun, F.col("_first")) > away(begun, F.col("_last"))
    turned = away(ended, F.col("_first")) > away(ended, F.col("_last"))
    rows = rows.withColumns({"_straight": F.coalesce(straight, F.lit(False)), "_turned": F.coalesce(turned, F.lit(False))})
    rows = rows.withColumn("_swaps", F.sum(F.when(F.col("_straight") & ~F.col("_turned"), 1).otherwise(0)).over(so_far))
    settled = F.when(F.col("_straight") == F.col("_turned"), F.struct(F.col("_straight").cast("int").alias("v"), F.col("_swaps").alias("at")))
    rows = rows.withColumn("_settled", F.last(settled, ignorenulls=True).over(so_far))
    value = (F.coalesce(F.col("_settled.v"), F.lit(0)) + F.col("_swaps") - F.coalesce(F.col("_settled.at"), F.lit(0))) % 2 == 1
    return rows.withColumn("turned", value).drop("_first", "_last", "_straight", "_turned", "_swaps", "_settled")


def stepped(df: DataFrame, step: float, between: int = 50, keys: tuple[str, ...] = ("bid",), place: str = "place") -> DataFrame:
    """keys, place, x, y, at: points of each polyline that are at least ``step`` from the one before.

    Each segment is cut into ``between`` pieces (without its end); the first point
    stays, and then the first one that is ``step`` or more from the last that
    stayed. at: where it lies, in segments; the polyline's very last point is never taken.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    parts = np.arange(between) / between

    def new_state(key: tuple) -> Callable:
        before, kept, n = None, None, 0

        def row(r: tuple) -> list[tuple]:
            nonlocal before, kept, n
            (i, x, y), out = r, []
            if before is not None:
                px, py = before
                xs, ys, low = px + parts * (x - px), py + parts * (y - py), 0
                while low < between:
                    far = np.flatnonzero(np.hypot(xs[low:] - kept[0], ys[low:] - kept[1]) >= step) if kept else np.zeros(1, dtype=int)
                    if not len(far):
                        break
                    low += int(far[0])
                    kept = (float(xs[low]), float(ys[low]))
                    out.append((*key, n, *kept, i - 1 + float(parts[low])))
                    n, low = n + 1, low + 1
            before = (x, y)
            return out

        return row

    w = Window.partitionBy(*keys).orderBy(place)
    rows = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("_i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return along_sorted(rows, list(keys), ["_i"], new_state, f"{kinds}, place long, x double, y double, at double")
