"""Shapes drawn from the ``events`` table: an object's poses with outlines, and pairs of bodies that cross.

The test tables hold no images, so what these operators take is drawn with
integers from each track's rows: every stretch of an object's observations is a
pose (a bent band) and a crossing of two bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.tracks import T_SQL, TRACKS_PER_OBJECT, observations, with_segments

PAUSE = 24 * 3600
HALF = 2  # of a band's width
BAR = 6  # half a bar's length


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def poses(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda events: events) -> DataFrame:
    """bid, frame, time, spine, outline: a row for each stretch of an object without a pause of a day. ``dealt``: as of ``observations``.

    The spine zigzags from left to right with steps of one pixel; the outline goes
    round the band of pixels at most ``HALF`` above or below it.
    """
    rows = with_segments(observations(spark, sf_dir, dealt), PAUSE).groupBy("bid", F.col("segment").alias("frame"))
    rows = rows.agg(F.min("time").alias("time"), F.sum("y").cast("long").alias("k"), F.floor(F.min("x")).cast("int").alias("x0"), F.floor(F.min("y")).cast("int").alias("y0"))
    n, at = F.lit(24) + F.col("k") % 9, lambda j: F.col("y0") + F.abs((j + F.col("k")) % 16 - 8)
    rows = rows.withColumn("n", n.cast("int"))
    line = lambda low, high, up: F.transform(F.sequence(low, high), lambda j: _point(F.col("x0") + j, at(j) + up))
    end, zero = F.col("n") - 1, F.lit(0)
    side = lambda j, low, high: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: _point(F.col("x0") + j, at(j) + i))
    outline = F.concat(line(zero, end, HALF), side(end, HALF - 1, 1 - HALF), line(end, zero, -HALF), side(zero, 1 - HALF, HALF - 1))
    return rows.select("bid", F.col("frame").cast("long").alias("frame"), "time", line(zero, end, 0).alias("spine"), outline.alias("outline"))


#: ``poses`` in SQL: p(bid, frame, time, n, x0, y0, k) and spines s_(bid, frame, place, x, y), outlines o_(bid, frame, place, x, y).
P_SQL = T_SQL + f""", q AS (SELECT *, sum(new) OVER (PARTITION BY bid ORDER BY frame) AS segment FROM (SELECT *, CAST(coalesce(time - lag(time) OVER (PARTITION BY bid ORDER BY frame) >= {PAUSE}, false) AS BIGINT) AS new FROM t)),
p AS (SELECT bid, CAST(segment AS BIGINT) AS frame, min(time) AS time, CAST(24 + CAST(sum(y) AS BIGINT) % 9 AS INT) AS n, CAST(floor(min(x)) AS INT) AS x0, CAST(floor(min(y)) AS INT) AS y0, CAST(sum(y) AS BIGINT) AS k FROM q GROUP BY bid, segment),
s_ AS (SELECT bid, frame, time, j AS place, x0 + j AS x, y0 + abs((j + k) % 16 - 8) AS y, n, x0, y0, k FROM p, unnest(range(n)) AS r(j)),
o_ AS (SELECT bid, frame, j AS place, x, y + {HALF} AS y FROM (SELECT *, place AS j FROM s_) UNION ALL SELECT bid, frame, n + {HALF - 1} - i, x, y + i FROM s_, unnest(range({1 - HALF}, {HALF})) AS r(i) WHERE place = n - 1
  UNION ALL SELECT bid, frame, 2 * n + {2 * HALF - 2} - place, x, y - {HALF} FROM s_ UNION ALL SELECT bid, frame, 2 * n + {2 * HALF - 1 + HALF - 1} + i, x, y + i FROM s_, unnest(range({1 - HALF}, {HALF})) AS r(i) WHERE place = 0)"""


def crossing_poses(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda events: events) -> DataFrame:
    """collision, k, truth of each pose: what ``crossings`` draws its crossing from, and how that ends."""
    nodes = poses(spark, sf_dir, dealt).select((F.col("bid") * TRACKS_PER_OBJECT + F.col("frame")).alias("collision"), (F.size("spine") + F.col("frame")).alias("k"))
    return nodes.withColumn("truth", F.when(F.col("k") % 2 == 0, "straight").otherwise("crossed"))


def crossings(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda events: events) -> DataFrame:
    """collision, role, frame, points, truth: a crossing for each pose, a row for each mask of it. All masks of a crossing come from one row of a task.

    Roles: a, b (the parents' last masks), c (the masks of the collision, by
    frame), x, y (the children's first). truth: does a go on as x (straight) or as
    y (crossed)? Two bars come from the left and the right until their ends overlap,
    b up to five pixels higher; then one goes up and the other down.
    """
    k, t = F.col("k"), F.col("frame")
    nodes = crossing_poses(spark, sf_dir, dealt).select("collision", "truth", (k % 2 == 0).alias("even"), (8 + k % 7).cast("int").alias("frames"), (k % 6).cast("int").alias("up"), F.when(k % 4 < 2, 1).otherwise(-1).alias("way"))
    nodes = nodes.withColumn("last", F.col("frames") + 1).withColumn("half", F.floor(F.col("last") / 2).cast("int"))
    last, half = F.col("last"), F.col("half")
    row = lambda role, t: F.struct(F.lit(role).alias("role"), t.cast("int").alias("frame"))
    marks = F.concat(F.array(row("a", F.lit(0)), row("b", F.lit(0)), row("x", last), row("y", last)), F.transform(F.sequence(F.lit(1), F.col("frames")), lambda t: row("c", t)))
    rows = nodes.select("*", F.explode(marks).alias("m")).select("*", "m.*")
    # numbers of a row first, then pixels: what stands inside a transform is computed for each pixel
    near = F.floor(9 * F.least(t, half) / half).cast("int")
    apart = F.col("way") * F.floor(14 * F.greatest(t - half, F.lit(0)) / (last - half)).cast("int")
    rows = rows.withColumns({"_near": near, "_apart": apart})
    rows = rows.select("collision", "role", "frame", "truth", "even", (F.col("_near") - 14).alias("ax"), F.col("_apart").alias("ay"), (14 - F.col("_near")).alias("bx"), (F.col("up") - F.col("_apart")).alias("by"))
    cells = F.array(*[_point(F.lit(i), F.lit(j)) for i in range(-BAR, BAR + 1) for j in range(-HALF, HALF + 1)])
    bar = lambda x, y: F.transform(cells, lambda p: _point(p.x + F.col(x), p.y + F.col(y)))
    a, b = bar("ax", "ay"), bar("bx", "by")
    both = F.concat(a, F.filter(b, lambda p: (F.abs(p.x - F.col("ax")) > BAR) | (F.abs(p.y - F.col("ay")) > HALF)))
    of_a = (F.col("role") == "a") | (F.col("role") == F.when(F.col("even"), "x").otherwise("y"))
    return rows.select("collision", "role", "frame", F.when(F.col("role") == "c", both).when(of_a, a).otherwise(b).alias("points"), "truth")
