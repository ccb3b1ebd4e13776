"""Readings of tracks: selections of rows, per-track statistics, curves over many tracks, parameter sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import deskew
from trackloom.operators.series import speed, turning_angle


def in_time_range(df: DataFrame, low: float, high: float, skipped: Column | None = None, time: str = "time") -> DataFrame:
    """Rows with low <= time <= high that aren't skipped."""
    rows = df.where(F.col(time).between(low, high))
    return rows if skipped is None else rows.where(~F.coalesce(skipped, F.lit(False)))


def unflagged(df: DataFrame, flags: DataFrame, key: str = "bid", frame: str = "frame") -> DataFrame:
    """Rows whose flag (key, frame, flag) is true; rows without a flag are left out."""
    return df.join(flags.where("flag").select(key, frame).distinct(), [key, frame], "left_semi")


def eligible(df: DataFrame, least_rows: int, least_time: float, key: str = "bid", time: str = "time") -> DataFrame:
    """key, n, duration of the tracks with enough rows over enough time."""
    return df.groupBy(key).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("duration")).where((F.col("n") >= least_rows) & (F.col("duration") >= least_time))


def typical_value(values: DataFrame, matches: DataFrame, column: str, key: str = "bid") -> DataFrame:
    """The median of a column over all matches: an object counts as often as it was matched."""
    return matches.select(key).join(values.select(key, column), key).agg(F.median(column).alias(column))


def common_series(tables: list[DataFrame], time: str = "time", digits: int = 1) -> DataFrame:
    """All tables' rows with times rounded, as one."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.withColumn(time, F.round(time, digits))


def track_statistics(df: DataFrame, key: str = "bid", order: str = "frame") -> DataFrame:
    """key, length of the path, mean and median speed, mean, median and summed size of the turns."""
    rows = turning_angle(speed(df, key, order), key, order)
    w = Window.partitionBy(key).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = rows.withColumns({"_step": step, "_turn": F.abs("angle")})
    return rows.groupBy(key).agg(F.sum("_step").alias("length"), F.avg("speed").alias("mean_speed"), F.median("speed").alias("median_speed"), F.avg("_turn").alias("mean_turn"), F.median("_turn").alias("median_turn"), F.sum("_turn").alias("turned"))


def step_noise(df: DataFrame, key: str = "bid", order: str = "frame") -> DataFrame:
    """key, n, mean, deviation and largest of the steps between rows."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return df.withColumn("_s", step).groupBy(key).agg(F.count("_s").alias("n"), F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("deviation"), F.max("_s").alias("largest"))


def sweep(df: DataFrame, column: str, widths: list[int], key: str = "bid", order: str = "frame") -> DataFrame:
    """width, n, error: how far centred means over several widths are from the values, on average; full windows only.

    A window for each width over one partitioning; no copies of the rows.
    """
    w = Window.partitionBy(key).orderBy(order)
    errors = {}
    for n in widths:
        near = w.rowsBetween(-(n // 2), n // 2)
        errors[f"_{n}"] = F.when(F.count(F.lit(1)).over(near) == n, F.abs(F.col(column) - F.avg(column).over(near)))
    rows = df.withColumns(errors).agg(*[F.struct(F.lit(n).alias("width"), F.count(f"_{n}").alias("n"), F.avg(f"_{n}").alias("error")).alias(f"_{n}") for n in widths])
    return rows.select(F.explode(F.array(*[f"_{n}" for n in widths])).alias("r")).select("r.*")


def compiled_curves(df: DataFrame, column: str, step: float, last: int, key: str = "bid", time: str = "time") -> DataFrame:
    """tick (0 ... last), n, mean of many tracks' curves: a track's value at a tick of its own time is that of its next row, else of its last."""
    own = Window.partitionBy(key)
    ticks = F.ceil((F.col(time) - F.min(time).over(own)) / step).cast("long")
    rows = df.withColumn("tick", ticks).where(F.col("tick") <= last)
    w = Window.partitionBy(key, "tick").orderBy(time)
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "tick", column)
    ordered = Window.partitionBy(key).orderBy("tick")
    before, after = F.lag("tick").over(ordered), F.lead("tick").over(ordered)
    low = F.coalesce(before + 1, F.lit(0))  # a value also stands for the ticks since the row before it
    high = F.when(after.isNull(), F.lit(last)).otherwise(F.col("tick"))
    filled = rows.withColumns({"_low": low, "_high": high}).withColumn("tick", F.explode(F.sequence("_low", "_high")))
    return filled.groupBy("tick").agg(F.count(column).alias("n"), F.avg(column).alias("mean"))


def without_frames(df: DataFrame, start: int, stop: int, frame: str = "frame") -> DataFrame:
    """Without the rows from ``start`` up to, but not at, ``stop``."""
    return df.where((F.col(frame) < start) | (F.col(frame) >= stop))


def every_nth(df: DataFrame, n: int, more_than: int, key: str = "bid", order: str = "frame") -> DataFrame:
    """Every n-th row, from the first, of the tracks with more rows than that."""
    w = Window.partitionBy(key)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return rows.where((F.col("_n") > more_than) & (F.col("_i") % n == 0)).drop("_i", "_n")


def midline_points(df: DataFrame, midline: str, keys: list[str], points: int = 11) -> DataFrame:
    """keys, point, x, y of the midlines that have all their points."""
    whole = df.where(F.size(midline) == points)
    return whole.select(*keys, F.posexplode(midline).alias("point", "_p")).select(*keys, "point", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def smooth_midlines(points: DataFrame, width: int, key: str = "bid", order: str = "frame") -> DataFrame:
    """x and y of each point of a midline as centred means over ``width`` times, shorter at the ends."""
    near = Window.partitionBy(key, "point").orderBy(order).rowsBetween(-(width // 2), width // 2)
    return points.withColumns({c: F.avg(c).over(near) for c in ("x", "y")})


def moved_ids(df: DataFrame, least: float, key: str = "bid", order: str = "frame") -> DataFrame:
    """key of the tracks whose box has a diagonal of ``least``."""
    box = df.groupBy(key).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_moved"))
    return box.where(F.col("_moved") >= least).select(key)


def accuracy_of_moved(df: DataFrame, least: list[float], good: Column, key: str = "bid", frame: str = "frame") -> DataFrame:
    """least, n, good, share: rows of tracks that moved at least so far, and how many of them are good."""
    rows = df.withColumn("_good", F.coalesce(good, F.lit(False)))
    boxes = df.groupBy(key).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_moved"))
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if("_good").alias("good")).join(boxes, key)
    levels = per.withColumn("least", F.explode(F.array(*[F.lit(float(v)) for v in least]))).where(F.col("_moved") >= F.col("least"))
    return levels.groupBy("least").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("share", F.try_divide("good", "n"))


def state_input(df: DataFrame, column: str, key: str = "bid", order: str = "frame", e: float = 0.1) -> DataFrame:
    """What a state model reads: the deskewed values of a track from its second row on."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i > 1").withColumn("value", deskew(F.col(column), e)).drop("_i")


def matrix_rows(spark, path: str) -> DataFrame:
    """row (numbers of one line) and file of text files with numbers between white space; lines without numbers are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line")).where("line != ''")
    return lines.select("file", F.transform(F.split("line", r"\s+"), lambda v: v.try_cast("double")).alias("row"))


def write_matrix(df: DataFrame, values: str, path: str) -> None:
    """One line a row: its numbers between spaces."""
    df.select(F.array_join(F.transform(values, lambda v: v.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def datasets(spark, path: str) -> DataFrame:
    """file, size, changed of the files below a folder, without reading them; Spark's reader leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def recording_info(spark, path: str) -> DataFrame:
    """The recordings' descriptions: one JSON document a file."""
    return spark.read.option("multiLine", "true").json(path)


def combined_sheets(sheets: list[DataFrame], names: dict[str, str], need: str, number: str) -> DataFrame:
    """Sheets with their columns renamed, as one table of the rows with ``need``, and ``number`` as a whole number where it is one."""
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumnsRenamed(names) for s in sheets])
    return one.where(F.col(need).isNotNull()).withColumn(number, F.col(number).try_cast("long"))
