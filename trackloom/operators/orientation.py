"""Orientation of long bodies over time: unwrapped on an even grid, with the times at which it can't be trusted (coils) or changes (turns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.series import boxcar, interpolate_grid, run_lengths, wrap_angle
from trackloom.sources.tracks import with_segments


def mean_filled(df: DataFrame, column: str, width: int, keys: tuple[str, ...], by: str) -> DataFrame:
    """``column`` as its centred mean over ``width`` rows; rows near an end, without a full window, take the nearest one's."""
    df = df.withColumn("_key", F.struct(*keys))
    w = Window.partitionBy("_key").orderBy(by)
    smooth = boxcar(df, column, width, "_key", by)
    ahead, back = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.first("smooth", ignorenulls=True).over(ahead), F.last("smooth", ignorenulls=True).over(back))
    return smooth.withColumn(column, filled).drop("smooth", "_key")


def orientations(
    df: DataFrame,
    angle: str,
    width: str,
    length: str,
    key: str = "bid",
    time: str = "time",
    order: str = "frame",
    gap: float = 5.0,
    window: int = 11,
    step: float = 0.2,
    coil: tuple[float, int] = (0.4, 10),
    turning: tuple[float, int] = (0.01, 1),
    least_seconds: float = 5.0,
) -> DataFrame:
    """key, segment, tick, ar, orientation, change, is_coil, is_reorienting on the multiples of ``step`` seconds.

    A series ends where ``gap`` seconds pass; series of fewer than ``window`` rows,
    or of less than ``least_seconds`` on the grid, are left out. ar: smoothed width
    over smoothed length. orientation: the angle, unwrapped since the series'
    first row. change: its smoothed steps. is_coil: ar is over coil[0] for more
    than coil[1] ticks on end; is_reorienting: the change is over turning[0] for
    more than turning[1].
    """
    keys = (key, "segment")
    parts = Window.partitionBy(*keys)
    w = parts.orderBy(order)
    rows = with_segments(df.select(key, time, order, F.col(angle).alias("_angle"), F.col(width).alias("_width"), F.col(length).alias("_length")), gap, key, time, order)
    rows = rows.withColumn("_rows", F.count(F.lit(1)).over(parts)).where(F.col("_rows") >= window).drop("_rows")
    rows = rows.withColumn("change", wrap_angle(F.coalesce(F.col("_angle") - F.lag("_angle").over(w), F.col("_angle"))))
    rows = rows.withColumn("orientation", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for column in ("_width", "_length", "change"):
        rows = mean_filled(rows, column, window, keys, order)
    rows = rows.withColumn("ar", F.try_divide("_width", "_length")).withColumn("_key", F.struct(*keys))
    grid = interpolate_grid(rows, step, ["ar", "orientation", "change"], "_key", time)
    for name, hit, least in (("is_coil", F.col("ar") > coil[0], coil[1]), ("is_reorienting", F.abs("change") > turning[0], turning[1])):
        grid = run_lengths(grid.withColumn("_hit", F.coalesce(hit, F.lit(False))), "_hit", "_key", "tick").withColumn(name, F.col("run") > least).drop("run", "_hit")
    span = F.max("tick").over(Window.partitionBy("_key")) - F.min("tick").over(Window.partitionBy("_key"))
    kept = grid.withColumn("_span", span * step).where(F.col("_span") >= least_seconds)
    return kept.select("_key.*", "tick", "ar", "orientation", "change", "is_coil", "is_reorienting")
