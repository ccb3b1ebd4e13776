"""Speed and behaviour of tracks: filling, padding, smoothing, grids and outliers as windows over a segment.

A segment (``keys``) is a stretch of an object's rows without a long pause;
``order`` and ``time`` are never null in it. Nothing is gathered: every step is a
window or makes new rows from two neighbours. Segments of one row have no speed;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.series import wrap_angle

KEYS = ("bid", "segment")


def fill_long_gaps(df: DataFrame, unit: float, columns: list[str], keys=KEYS, time: str = "time") -> DataFrame:
    """keys, time, ``columns``: a row before a step of more than ``unit`` gives way to ten points for each whole unit of it, ends left out; values are linear."""
    w = Window.partitionBy(*keys).orderBy(time)
    ahead = [F.lead(c).over(w).alias(f"_{c}") for c in [time, *columns]]
    steps = df.select(*keys, time, *columns, *ahead)
    step = F.col(f"_{time}") - F.col(time)
    n = 10 * F.floor(step / unit).cast("int")
    parts = F.when(step > unit, F.transform(F.sequence(F.lit(1), n - 2), lambda i: i / (n - 1))).otherwise(F.array(F.lit(0.0)))
    points = steps.withColumn("_part", F.explode(parts))
    between = lambda c: F.when(F.col("_part") == 0, F.col(c)).otherwise(F.col(c) + F.col("_part") * (F.col(f"_{c}") - F.col(c))).alias(c)
    return points.select(*keys, *map(between, [time, *columns]))


def padded_boxcar(df: DataFrame, columns: list[str], width: int, keys=KEYS, order: str = "time") -> DataFrame:
    """``columns`` as centred means over ``width`` rows (odd); beyond the ends stand the first and last value."""
    half, w, whole = width // 2, Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    near = w.rowsBetween(-half, half)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(whole)})
    before, after = F.greatest(half + 1 - F.col("_n"), F.lit(0)), F.greatest(F.col("_n") + half - F.col("_all"), F.lit(0))
    smooth = {c: (F.sum(c).over(near) + before * F.first(c).over(every) + after * F.last(c).over(every)) / width for c in columns}
    return df.withColumns(smooth).drop("_n", "_all")


def on_grid(df: DataFrame, step: float, columns: list[str], keys=KEYS, time: str = "time") -> DataFrame:
    """keys, tick, ``columns`` at the multiples of ``step`` inside a segment, linear between neighbours."""
    w = Window.partitionBy(*keys).orderBy(time)
    ahead = [F.lead(c).over(w).alias(f"_{c}") for c in [time, *columns]]
    pairs = df.select(*keys, time, *columns, *ahead).where(F.col(f"_{time}") > F.col(time))
    low, high = F.ceil(F.col(time) / step), F.ceil(F.col(f"_{time}") / step) - 1
    points = pairs.where(low <= high).withColumn("tick", F.explode(F.sequence(low, high)))
    part = (F.col("tick") * step - F.col(time)) / (F.col(f"_{time}") - F.col(time))
    return points.select(*keys, "tick", *[(F.col(c) + part * (F.col(f"_{c}") - F.col(c))).alias(c) for c in columns])


def _mean(values: Column) -> Column:
    """Mean of an array, added up in order."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _spread(values: Column) -> Column:
    """Population deviation of an array by running means.

    Ten almost equal speeds deviate by rounding alone, and whether one of them is
    far from the others hangs on the last bit; each step is rounded as SQL engines
    with this algorithm round it, which ``stddev_pop`` does otherwise.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(values, start, add, lambda s: F.sqrt(s["squares"] / s["n"]))


def drop_outliers(df: DataFrame, column: str, keys=KEYS, order: str = "tick", rounds: int = 10, limit: float = 2.3263, least_rows: float = 23.1) -> DataFrame:
    """``df`` without rows that are more than ``limit`` deviations from the mean of the ten rows around, looked for ``rounds`` times in what is left.

    The five rows at both ends stay, and so do segments of fewer than
    ``least_rows`` rows. All rounds use one partitioning.
    """
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    near = w.rowsBetween(-5, 4)
    for _ in range(rounds):
        n, at = F.count(F.lit(1)).over(whole), F.row_number().over(w)
        df = df.withColumns({"_near": F.collect_list(column).over(near), "_inner": (n >= least_rows) & (at > 5) & (at <= n - 5)})
        spread = _spread(F.col("_near"))
        far = (F.abs(F.col(column) - _mean(F.col("_near"))) > limit * spread) & (spread > 0)
        df = df.withColumn("_far", F.coalesce(F.when(F.col("_inner"), far), F.lit(False))).where("NOT _far").drop("_far", "_near", "_inner")
    return df


def segment_speed(df: DataFrame, unit: float = 1.0, width: int = 15, keys=KEYS, remove_outliers: bool = True) -> DataFrame:
    """keys, tick (number of the ``unit``), x, y, speed (per unit): long gaps filled, smoothed, put on a grid of ``unit``; a segment's first tick has no speed and is left out."""
    filled = padded_boxcar(fill_long_gaps(df, unit, ["x", "y"], keys), ["x", "y"], width, keys)
    grid = on_grid(filled, unit, ["x", "y"], keys)
    w = Window.partitionBy(*keys).orderBy("tick")
    steps = grid.withColumns({f"_{c}": F.col(c) - F.lag(c).over(w) for c in ("x", "y", "tick")})

    def squares(values: pa.Array) -> pa.Array:
        """By C's ``pow``, which SQL engines raise with: it rounds one in 2,000 otherwise than a product."""
        return pa.array([x if x is None else math.pow(x, 2.0) if abs(x) < 1e150 else x * x for x in values.to_pylist()], pa.float64())

    square = F.arrow_udf(squares, "double")
    out = steps.withColumn("speed", F.sqrt(square("_x") + square("_y")) / F.col("_tick")).where("speed IS NOT NULL").drop("_x", "_y", "_tick")
    return drop_outliers(out, "speed", keys) if remove_outliers else out


def slow_enough(speeds: DataFrame, most: float, key: str = "bid") -> DataFrame:
    """The rows of the objects whose greatest speed is at most ``most``."""
    greatest = F.max("speed").over(Window.partitionBy(key))  # in the task that has the object's rows: they are neither made twice nor joined
    return speeds.where(F.col(key).isNotNull()).withColumn("_most", greatest).where(F.col("_most") <= most).drop("_most")


def long_segments(df: DataFrame, least_rows: int, least_time: float, start: float | None = None, keys=KEYS, time: str = "time") -> DataFrame:
    """Rows from ``start`` on of segments that have ``least_rows`` of them and last more than ``least_time``."""
    whole = Window.partitionBy(*keys)
    df = df if start is None else df.where(F.col(time) >= start)
    n, lasts = F.count(F.lit(1)).over(whole), F.max(time).over(whole) - F.min(time).over(whole)
    return df.withColumn("_fits", (n >= least_rows) & (lasts > least_time)).where("_fits").drop("_fits")


def whole_windows(df: DataFrame, size: float, column: str, keys=("bid",), time: str = "time") -> DataFrame:
    """keys, part, n, loc, scale, t0, tN of ``column`` in the whole windows of ``size`` since a series' start; a row on a border counts in both."""
    whole = Window.partitionBy(*keys)
    at = (F.col(time) - F.min(time).over(whole)) / size
    parts = F.floor((F.max(time).over(whole) - F.min(time).over(whole)) / size)
    rows = df.withColumns({"_at": at, "_parts": parts})
    mine = F.when((F.col("_at") == F.floor("_at")) & (F.col("_at") > 0), F.array(F.floor("_at") - 1, F.floor("_at"))).otherwise(F.array(F.floor("_at")))
    rows = rows.withColumn("part", F.explode(mine)).where("part < _parts")
    return rows.groupBy(*keys, "part").agg(F.count(column).alias("n"), F.avg(column).alias("loc"), F.stddev_pop(column).alias("scale"), F.min(time).alias("t0"), F.max(time).alias("tN"))


def unwrapped(df: DataFrame, column: str, out: str, keys=KEYS, order: str = "frame") -> DataFrame:
    """``out``: the angle ``column`` without jumps of whole turns."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_turn", F.coalesce(wrap_angle(F.col(column) - F.lag(column).over(w)), F.lit(0.0)))
    return df.withColumn(out, F.first(column).over(w) + F.sum("_turn").over(w)).drop("_turn")


def behaviour(df: DataFrame, body_length: float, keys=KEYS, order: str = "frame") -> DataFrame:
    """``df`` (time, x, y, len_x, len_y, length, width) with movement and posture: move_or, orientation, speed (body lengths), speed_along, speed_perp, angular_v, ar, minutes."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in ("x", "y", "time"))
    df = df.withColumns({"_d": F.hypot(dx, dy), "_dt": dt, "move_or": F.atan2(dy, dx), "_facing": F.atan2("len_y", "len_x")})
    df = unwrapped(df, "_facing", "orientation", keys, order)
    theta, rate = F.col("orientation") - F.col("move_or"), F.try_divide(F.col("_d"), F.col("_dt"))
    df = df.withColumns({
        "speed": rate / body_length, "speed_perp": rate * F.sin(theta), "speed_along": rate * F.cos(theta),
        "angular_v": F.try_divide(F.col("orientation") - F.lag("orientation").over(w), F.col("_dt")),
        "ar": F.try_divide(F.col("width"), F.col("length")), "minutes": F.col("time") / 60,
    })
    return df.drop("_d", "_dt", "_facing")


def usual_lengths(df: DataFrame, column: str, keys=("bid",), deviations: float = 2.0) -> DataFrame:
    """usual: within ``deviations`` population deviations of the object's mean."""
    whole = Window.partitionBy(*keys)
    return df.withColumn("usual", F.abs(F.col(column) - F.avg(column).over(whole)) < deviations * F.stddev_pop(column).over(whole))


def true_intervals(df: DataFrame, flag: Column, key: str = "bid", order: str = "frame", time: str = "time") -> DataFrame:
    """key, start, end of each stretch of true flags, to the time of the first false one after it; a stretch without end is left out."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, time, F.coalesce(flag, F.lit(False)).alias("_flag"))
    rows = rows.withColumn("_run", F.sum((~F.col("_flag")).cast("int")).over(w))  # a false flag ends the run before it
    out = rows.groupBy(key, "_run").agg(F.min(F.when(F.col("_flag"), F.col(time))).alias("start"))
    ends = rows.where("NOT _flag").select(key, (F.col("_run") - 1).alias("_run"), F.col(time).alias("end"))
    return out.join(ends, [key, "_run"]).where("start IS NOT NULL").select(key, "start", "end")


def inside_intervals(points: DataFrame, intervals: DataFrame, key: str = "bid", time: str = "time") -> DataFrame:
    """The points with start <= time < end of one of their key's disjoint intervals, and that interval; one sort of both, no join of all pairs."""
    both = points.withColumns({"_start": F.lit(None).cast("double"), "start": F.lit(None).cast("double"), "end": F.lit(None).cast("double"), "_late": F.lit(1)})
    marks = intervals.select(key, F.col("start").alias(time), F.col("start").alias("_start"), "start", "end", F.lit(0).alias("_late"))
    w = Window.partitionBy(key).orderBy(time, "_late")
    both = both.unionByName(marks, allowMissingColumns=True).withColumns({"start": F.last("start", True).over(w), "end": F.last("end", True).over(w)})
    return both.where((F.col("_late") == 1) & (F.col(time) < F.col("end"))).drop("_start", "_late")
