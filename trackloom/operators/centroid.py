"""Centroid paths made ready to measure: smoothed, still where they stand, on an even grid, with speeds and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.curves import smoothed
from trackloom.operators.resets import signed_turns
from trackloom.operators.series import interpolate_grid, speed
from trackloom.operators.stops import moves_and_stops, stop_intervals


def held_still(df: DataFrame, stops: DataFrame, key: str = "bid", order: str = "frame") -> DataFrame:
    """``df`` with x and y of all rows of a stop (key, start, end) replaced by their medians there; stops of a key don't overlap."""
    places = stops.select(key, F.col("start").alias("_stop"), F.explode(F.sequence("start", "end")).alias(order))
    inside = df.select(key, order, "x", "y").join(places, [key, order])
    middle = inside.groupBy(key, "_stop").agg(F.median("x").alias("_x"), F.median("y").alias("_y"))
    still = places.join(middle, [key, "_stop"]).drop("_stop")
    return df.join(still, [key, order], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("x", "y")}).drop("_x", "_y")


def measured(df: DataFrame, key: str = "bid", time: str = "time", order: str = "frame") -> DataFrame:
    """``df`` with speed (from the row before) and turn (between the steps to and from a row, signed, in degrees)."""
    turns = signed_turns(df, key, order, time).select(key, order, "turn")
    return speed(df, key, order).join(turns, [key, order], "left")


def smoothed_and_spaced(df: DataFrame, smooth: tuple[int, int] | None = (25, 5), step: float = 1.0, key: str = "bid", time: str = "time", order: str = "frame") -> DataFrame:
    """key, tick, time, x, y, speed, turn of a path on the multiples of ``step`` seconds; smooth: width and order of a filter before, if any.

    A series of no more rows than half the filter's width has no smoothed values and is left out.
    """
    rows = smoothed(df, *smooth, (key,), order).where("x is not null") if smooth else df
    grid = interpolate_grid(rows, step, ["x", "y"], key, time)
    grid = grid.select(key, "tick", (F.col("tick") * step).alias(time), "x", "y")
    return measured(grid, key, time, "tick")


def centroid_package(
    df: DataFrame,
    before: tuple[int, int] = (25, 5),
    least: int = 30,
    distance: float = 0.25,
    most: int = 500,
    after: tuple[int, int] = (75, 5),
    step: float = 0.1,
    key: str = "bid",
    time: str = "time",
    order: str = "frame",
) -> tuple[DataFrame, DataFrame]:
    """(path, stretches) of raw positions; rows are numbered by ``order`` from 1 without gaps.

    Positions are smoothed (``before``: width and order); where an object stays
    within ``distance`` for more than ``least`` rows it is put at the median; then
    they are smoothed again (``after``) and set on a grid of ``step`` seconds, with
    speed and turn. stretches: key, start, end (times), moving, seconds.
    """
    rows = smoothed(df.select(key, order, time, "x", "y"), *before, (key,), order).where("x is not null")
    stops = stop_intervals(rows, distance, least, most, key, order)
    path = smoothed_and_spaced(held_still(rows, stops, key, order), after, step, key, time, order)
    spans = rows.groupBy(key).agg(F.min(order).alias("low"), F.max(order).alias("high"))
    parts = moves_and_stops(stops, spans, key)
    at = rows.select(key, order, time)
    for c in ("start", "end"):
        parts = parts.join(at.select(key, F.col(order).alias(c), F.col(time).alias(f"_{c}")), [key, c])
    stretches = parts.select(key, F.col("_start").alias("start"), F.col("_end").alias("end"), "moving", (F.col("_end") - F.col("_start")).alias("seconds"))
    return path, stretches
