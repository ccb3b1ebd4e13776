"""Filters, joins and aggregates on track tables (one row a track: bounds, terminals, sizes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = 1e9


def bounds(obs: DataFrame, key: str = "bid") -> DataFrame:
    return obs.groupBy(key).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def sizes(obs: DataFrame, key: str = "bid") -> DataFrame:
    return obs.groupBy(key).agg(F.median("area").alias("area_median"))


def terminals(obs: DataFrame, key: str = "bid", order: str = "frame") -> DataFrame:
    """First and last position by order; least and greatest time and frame."""
    first, last = F.min_by(F.struct("x", "y"), order), F.max_by(F.struct("x", "y"), order)
    out = obs.groupBy(key).agg(first.alias("a"), last.alias("b"), F.min("time").alias("t0"), F.min("frame").alias("f0"), F.max("time").alias("tN"), F.max("frame").alias("fN"))
    return out.select(key, F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), "t0", "f0", F.col("b.x").alias("xN"), F.col("b.y").alias("yN"), "tN", "fN")


def basic_properties(obs: DataFrame, key: str = "bid", order: str = "frame") -> DataFrame:
    """Median area and the distance by three measures: box diagonal, path, end to end."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    ends = [F.min_by(c, order) for c in ("x", "y")] + [F.max_by(c, order) for c in ("x", "y")]
    return obs.withColumn("_step", step).groupBy(key).agg(
        F.median("area").alias("area_median"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diagonal"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"), F.hypot(ends[2] - ends[0], ends[3] - ends[1]).alias("end_to_end"), (F.max("time") - F.min("time")).alias("duration"),
    )


def worthy(tracks: DataFrame, min_size: float, min_duration: float, min_lengths: float, length: Column) -> DataFrame:
    """Tracks that are large, long and far-moving enough; the diagonal counts in units of ``length``."""
    diagonal = F.hypot(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    return tracks.where((F.col("area_median") >= min_size) & (F.col("tN") - F.col("t0") >= min_duration) & (F.try_divide(diagonal, length) >= min_lengths))


def centre() -> tuple[Column, Column]:
    return (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2


def inside_circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    return F.hypot(x - cx, y - cy) < r


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule; of points on an edge, those on a left or lower edge are inside."""
    inside = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:
            crosses = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            inside = inside + crosses.cast("int")
    return inside % 2 == 1


def moved_manhattan(tracks: DataFrame, typical: Column) -> DataFrame:
    """moved: (width + height of the bounds) in units of a typical length."""
    return tracks.withColumn("moved", F.try_divide(F.col("x_max") - F.col("x_min") + F.col("y_max") - F.col("y_min"), typical))


def moved_diagonal(box: DataFrame, size: DataFrame, key: str = "bid") -> DataFrame:
    """moved: diagonal of the bounds in units of the own size; a full join keeps objects of either table."""
    joined = box.join(size, key, "full")
    return joined.withColumn("moved", F.try_divide(F.hypot(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")), F.col("area_median")))


def alive_between(tracks: DataFrame, start: float, end: float) -> DataFrame:
    return tracks.where((F.col("t0") <= end) & (F.col("tN") >= start))


def merge_bounds(box: DataFrame, members: DataFrame, key: str = "bid", group: str = "node_id") -> DataFrame:
    """Bounds of groups: members (key, group); objects without a group stand for themselves."""
    named = box.join(members, key, "left").withColumn(group, F.coalesce(group, key))
    return named.groupBy(group).agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))


def gap_candidates(tracks: DataFrame, max_seconds: float, max_distance: float, slack: float = 0.0) -> DataFrame:
    """node1, node2, dist, dt: a track's end and another's start that are close in time (from -slack on) and space.

    A range join in three dimensions as an equi-join: time and both coordinates
    are cut into cells as long as their limits, and an end looks at the cells
    around its own.
    """
    reach = max(max_seconds, slack)
    cell = lambda c, size: F.floor(F.col(c) / size)
    ends = tracks.select(F.col("node_id").alias("node1"), "tN", "xN", "yN")
    for axis, c, size in (("ct", "tN", reach), ("cx", "xN", max_distance), ("cy", "yN", max_distance)):
        ends = ends.withColumn(axis, F.explode(F.array(*[cell(c, size) + k for k in (-1, 0, 1) if not (axis == "ct" and k < 0 and slack == 0)])))
    starts = tracks.select(F.col("node_id").alias("node2"), "t0", "x0", "y0", cell("t0", reach).alias("ct"), cell("x0", max_distance).alias("cx"), cell("y0", max_distance).alias("cy"))
    dt, dist = F.col("t0") - F.col("tN"), F.sqrt((F.col("x0") - F.col("xN")) * (F.col("x0") - F.col("xN")) + (F.col("y0") - F.col("yN")) * (F.col("y0") - F.col("yN")))
    found = ends.join(starts, ["ct", "cx", "cy"]).select("node1", "node2", dist.alias("dist"), dt.alias("dt"))
    return found.where((F.col("dt") + slack > 0) & (F.col("dt") < max_seconds) & (F.col("dist") < max_distance) & (F.col("node1") != F.col("node2")))


def nearest_in_time(left: DataFrame, right: DataFrame, left_time: str, right_time: str, left_key: str, payload: list[str], step: float) -> DataFrame:
    """Each left row with the right row of the nearest time (ties: the earlier, then the smaller payload).

    Both sides are put on one time line cut into steps of ``step``; every step
    gets the last right row before it and the first after it. In its own step a left row
    sees the last right row up to it and the first after it, by windows over both:
    no pairs are made.
    """
    r = right.select(F.col(right_time).alias("_rt"), *payload)
    cells = r.groupBy(F.floor(F.col("_rt") / step).alias("_cell")).agg(F.min(F.struct("_rt", *payload)).alias("first"), F.max(F.struct("_rt", *[F.col(c) for c in payload])).alias("last"))
    wanted = left.select(F.floor(F.col(left_time) / step).alias("_cell")).distinct()
    line = wanted.join(cells, "_cell", "full")  # one row a step, not a row a record
    line = line.withColumn("_part", F.floor(F.col("_cell") / 4096))
    edge = line.groupBy("_part").agg(F.max("last").alias("_l"), F.min("first").alias("_f"))
    over = Window.orderBy("_part")  # one row for 4,096 steps
    edge = edge.select("_part", F.max("_l").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_f").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inner = Window.partitionBy("_part").orderBy("_cell")
    line = line.join(edge, "_part").select(
        "_cell",
        F.coalesce(F.max("last").over(inner.rowsBetween(Window.unboundedPreceding, -1)), "_before").alias("_before"),
        F.coalesce(F.min("first").over(inner.rowsBetween(1, Window.unboundedFollowing)), "_after").alias("_after"),
    )
    l = left.withColumn("_cell", F.floor(F.col(left_time) / step))
    times = r.where("_rt IS NOT NULL").groupBy(F.floor(F.col("_rt") / step).alias("_cell"), "_rt").agg(F.min(F.struct("_rt", *payload)).alias("_m"))
    none = times.schema["_m"].dataType
    both = l.where("_cell IS NOT NULL").select("_cell", F.col(left_time).cast("double").alias("_at"), F.lit(1).alias("_side"), left_key, left_time, F.lit(None).cast(none).alias("_m"))
    kind = lambda c: left.schema[c].dataType
    both = both.unionAll(times.select("_cell", F.col("_rt").cast("double"), F.lit(0), F.lit(None).cast(kind(left_key)), F.lit(None).cast(kind(left_time)), "_m"))
    passed = lambda *order: F.last("_m", True).over(Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_last", passed("_at", "_side")).withColumn("_first", passed(F.desc("_at"), F.desc("_side")))  # a right row of the same time is the last
    own = both.where("_side = 1").select(left_key, left_time, F.explode(F.filter(F.array("_last", "_first"), lambda m: m.isNotNull())).alias("_m"))
    far = l.join(line, "_cell").select(left_key, left_time, F.explode(F.filter(F.array("_before", "_after"), lambda m: m.isNotNull())).alias("_m"))
    best = own.union(far).groupBy(left_key).agg(F.min(F.struct(F.abs(F.col("_m._rt") - F.col(left_time)).alias("d"), F.col("_m"))).alias("best"))
    return best.select(left_key, F.col("best.d").alias("distance"), F.col("best._m._rt").alias(right_time), *[F.col(f"best._m.{c}").alias(c) for c in payload])


def loss_reasons(ends: DataFrame, edge: float, far: float, horizon: float) -> DataFrame:
    """reason of each track's end; a later rule overrides an earlier one: on edge, split, join, outside, timing."""
    return ends.withColumn(
        "reason",
        F.when(F.col("tN") >= horizon, "timing").when((F.col("xN") >= far), "outside-roi").when(F.col("joins"), "join").when(F.col("splits"), "split").when((F.col("xN") < edge) | (F.col("yN") < edge), "on_edge").otherwise("unknown"),
    )


def taped(tracks: DataFrame, heads: DataFrame) -> DataFrame:
    """One row for each chain of tracks that gaps were bridged between (heads: old, new): node_id (the chain's first), segments (its tracks by time), t0, tN, duration, n, and the median area of the tracks' medians."""
    named = tracks.join(heads.select(F.col("old").alias("node_id"), F.col("new").alias("head")), "node_id", "left").withColumn("head", F.coalesce("head", "node_id"))
    parts = F.array_sort(F.collect_list(F.struct("t0", "node_id"))).getField("node_id")
    out = named.groupBy("head").agg(parts.alias("segments"), F.min("t0").alias("t0"), F.max("tN").alias("tN"), F.sum("n").alias("n"), F.median("area_median").alias("area_median"))
    return out.select(F.col("head").alias("node_id"), "segments", "t0", "tN", (F.col("tN") - F.col("t0")).alias("duration"), "n", "area_median")


def life_steps(tracks: DataFrame, body_lengths: str, least: float = 1.0) -> DataFrame:
    """node_id, body lengths, t0, tN, lifespan and mid in minutes of the tracks that moved ``least`` body lengths at least."""
    t0, end = F.col("t0") / 60, F.col("tN") / 60
    return tracks.where(F.col(body_lengths) >= least).select("node_id", body_lengths, t0.alias("t0"), end.alias("tN"), (end - t0).alias("lifespan"), ((t0 + end) / 2).alias("mid"))
