"""Stops and moves of a track, flat regions and series repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_neighbours(df: DataFrame, distance: float, most: int = 500, key: str = "bid", order: str = "frame") -> DataFrame:
    """score: how many rows just before, without a break and at most ``most``, are within ``distance``; 0 in the first three rows."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.reverse(F.collect_list(F.struct("x", "y")).over(w.rowsBetween(-most, -1)))
    far = F.transform(before, lambda p: F.hypot(p.x - F.col("x"), p.y - F.col("y")) > distance)
    df = df.withColumns({"_far": far, "_n": F.row_number().over(w)})
    run = F.when(F.array_contains("_far", True), F.array_position("_far", True) - 1).otherwise(F.size("_far"))
    return df.withColumn("score", F.when(F.col("_n") <= 3, 0).otherwise(run).cast("long")).drop("_far", "_n")


def merge_intervals(df: DataFrame, start: str, end: str, key: str = "bid") -> DataFrame:
    """key, start, end of the unions of intervals that meet."""
    w = Window.partitionBy(key).orderBy(start, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce(F.col(start) > so_far, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def stop_intervals(df: DataFrame, distance: float, least: int, most: int = 500, key: str = "bid", order: str = "frame") -> DataFrame:
    """key, start, end (by order): stretches in which a track stays within ``distance`` for more than ``least`` rows."""
    scored = trailing_neighbours(df, distance, most, key, order).where(F.col("score") > least)
    return merge_intervals(scored.select(key, (F.col(order) - F.col("score")).alias("start"), F.col(order).cast("long").alias("end")), "start", "end", key)


def moves_and_stops(stops: DataFrame, spans: DataFrame, key: str = "bid") -> DataFrame:
    """key, start, end, moving: stops (key, start, end) and the moves between them over each key's span (key, low, high)."""
    w = Window.partitionBy(key).orderBy("start")
    after = stops.select(key, F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), F.lit(None)).alias("end"))
    first = spans.join(stops.groupBy(key).agg(F.min("start").alias("end")), key, "left").select(key, F.col("low").alias("start"), "end", "high")
    after = after.join(spans.select(key, "high"), key).select(key, "start", "end", "high")
    moves = first.unionByName(after).select(key, "start", F.coalesce("end", "high").alias("end")).where("end > start").withColumn("moving", F.lit(True))
    return stops.select(key, "start", "end").withColumn("moving", F.lit(False)).unionByName(moves)


def thin_stops(df: DataFrame, stops: DataFrame, key: str = "bid", order: str = "frame") -> DataFrame:
    """Rows without those strictly inside a stop: its first and last row stay. Stops of a key don't overlap."""
    marks = stops.select(key, F.col("start").alias(order), F.lit(1).alias("_o")).union(stops.select(key, "end", F.lit(-1)))
    rows = df.withColumn("_o", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_mark", F.col("_o") != 0)
    w = Window.partitionBy(key).orderBy(order, F.desc("_o"))
    depth = F.sum("_o").over(w)  # openings sort before rows, rows before closings
    at_edge = F.max("_mark").over(Window.partitionBy(key, order))
    return both.withColumns({"_depth": depth, "_edge": at_edge}).where("not _mark and (_depth = 0 or _edge)").drop("_o", "_mark", "_depth", "_edge")


def fill_frames(df: DataFrame, columns: list[str], key: str = "bid", frame: str = "frame") -> DataFrame:
    """A row for every frame from a key's first up to, without, its last; missing ones are linear between their neighbours."""
    w = Window.partitionBy(key).orderBy(frame)
    pairs = df.select(key, frame, *columns, F.lead(frame).over(w).alias("_f"), *[F.lead(c).over(w).alias(f"_{c}") for c in columns]).where("_f is not null")
    grid = pairs.withColumn("_at", F.explode(F.sequence(F.col(frame), F.col("_f") - 1)))
    part = (F.col("_at") - F.col(frame)) / (F.col("_f") - F.col(frame))
    return grid.select(key, F.col("_at").alias(frame), *[(F.col(c) + part * (F.col(f"_{c}") - F.col(c))).alias(c) for c in columns])


def behaviour(df: DataFrame, column: str, limit: float, least: int, name: str, above: bool = True, key: str = "bid", order: str = "frame") -> DataFrame:
    """``name``: true in runs of at least ``least`` rows with the column over (or under) the limit."""
    from trackloom.operators.series import run_lengths

    hit = (F.col(column) > limit) if above else (F.col(column) < limit)
    return run_lengths(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), "_hit", key, order).withColumn(name, F.col("run") >= least).drop("run", "_hit")


def heading_votes(df: DataFrame, front: Column, back: Column, key: str = "bid", segment: str = "segment") -> DataFrame:
    """key, segment, swapped: does the back move more than the front in most rows of a segment?"""
    return df.groupBy(key, segment).agg((F.avg((front >= back).cast("int")) < 0.5).alias("swapped"))


def per_second(df: DataFrame, column: str, time: str = "time", step: float = 1.0) -> DataFrame:
    """second, mean, q1, q2, q3, n over all tracks."""
    p = F.percentile(column, [0.25, 0.5, 0.75])
    out = df.groupBy(F.floor(F.col(time) / step).alias("second")).agg(F.avg(column).alias("mean"), p.alias("_p"), F.count(column).alias("n"))
    return out.select("second", "mean", F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("q2"), F.col("_p")[2].alias("q3"), "n")


def turns_over(df: DataFrame, angle: str, limit: float, key: str = "bid", order: str = "frame") -> DataFrame:
    """key, n, total, mean of the turns, how many exceed the limit."""
    a = F.abs(F.col(angle))
    return df.groupBy(key).agg(F.count(angle).alias("n"), F.sum(a).alias("total"), F.avg(a).alias("mean"), F.count_if(a > limit).alias("over"))


def duplicate_frames(df: DataFrame, key: str = "bid", frame: str = "frame") -> DataFrame:
    """key, rows, duplicates, share of rows whose frame another row has too."""
    per = df.groupBy(key, frame).agg(F.count("*").alias("_c"))
    out = per.groupBy(key).agg(F.sum("_c").alias("rows"), F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)).alias("duplicates"))
    return out.withColumn("share", F.col("duplicates") / F.col("rows"))
