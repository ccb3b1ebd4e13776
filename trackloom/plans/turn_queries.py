"""Queries of sums that reset, and of centroid paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import centroid, curves, models, resets, spines
from trackloom.plans.registry import query
from trackloom.sources.shapes import poses
from trackloom.sources.tracks import T_SQL, observations

r6 = lambda c: F.round(c, 6) + 0.0
SPAN, LEAST, CHUNK = 12 * 3600, 90.0, 3 * 24 * 3600

TURNS_SQL = T_SQL + """, g AS (SELECT bid, frame, (lag(time) OVER w + 2 * time + lead(time) OVER w) / 4 AS time, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM t WINDOW w AS (PARTITION BY bid ORDER BY frame)),
h AS (SELECT bid, frame - 2 AS i, time, CASE WHEN (ax <> 0 OR ay <> 0) AND (bx <> 0 OR by_ <> 0) THEN degrees(atan2(ax * by_ - ay * bx + 0.0, ax * bx + ay * by_)) ELSE 0 END AS turn FROM g WHERE time IS NOT NULL),
u AS (SELECT *, sum(turn) OVER (PARTITION BY bid ORDER BY i) - turn AS before FROM h)"""
#: The rows at which a span is over, one after the other.
RESETS_SQL = TURNS_SQL + f""", later AS (SELECT a.bid, a.i, min(b.i) AS j FROM u a JOIN u b ON b.bid = a.bid AND b.time >= a.time + {SPAN} GROUP BY a.bid, a.i),
walk AS (SELECT bid, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS i FROM u WHERE i = 0 UNION ALL SELECT w.bid, greatest(w.i - 1, 0), l.j FROM walk w JOIN later l ON l.bid = w.bid AND l.i = w.i),
sums AS (SELECT w.bid, w.first, w.i - 1 AS last, e.before - s.before AS total, n.time AS until FROM walk w JOIN u n ON n.bid = w.bid AND n.i = w.i JOIN u e ON e.bid = w.bid AND e.i = w.i - 1 JOIN u s ON s.bid = w.bid AND s.i = w.first WHERE w.i > 0)"""


def _found(spark, sf_dir):
    turns = resets.signed_turns(observations(spark, sf_dir))
    return resets.resets(turns, SPAN, "turn", chunk=CHUNK)


@query(f"WITH RECURSIVE {RESETS_SQL} SELECT bid, first, last, round(total, 6) + 0.0 AS total, round(until, 6) AS until FROM sums")
def turn_sums(spark, sf_dir):
    """Net turn of each half day, counted from where the half day before ended."""
    return _found(spark, sf_dir).select("bid", "first", "last", r6("total").alias("total"), F.round("until", 6).alias("until"))


@query(f"WITH RECURSIVE {RESETS_SQL} SELECT bid, count(*) AS sums, count(*) FILTER (total >= {LEAST}) AS turns FROM sums GROUP BY bid")
def turn_counts(spark, sf_dir):
    return resets.turn_count(_found(spark, sf_dir), LEAST)


@query(f"WITH RECURSIVE {RESETS_SQL} SELECT s.bid, (s.first + s.last) // 2 AS middle, round(total, 6) + 0.0 AS total, round(t.time, 6) AS time, round(t.x, 6) AS x, round(t.y, 6) AS y FROM sums s JOIN t ON t.bid = s.bid AND t.frame - 1 = (s.first + s.last) // 2 WHERE total >= {LEAST}")
def turn_places(spark, sf_dir):
    """Where objects were in the middle of a half day of at least a quarter turn."""
    points = observations(spark, sf_dir).select("bid", (F.col("frame") - 1).alias("frame"), "time", "x", "y")
    out = resets.turn_middles(_found(spark, sf_dir), points, LEAST)
    return out.select("bid", "middle", r6("total").alias("total"), *[F.round(c, 6).alias(c) for c in ("time", "x", "y")])


WEIGHTS = models.savgol_weights(25, 5)
weighted = lambda c: " + ".join(f"({w!r}) * " + (c if k == 0 else f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER w") for k, w in zip(range(-12, 13), WEIGHTS))
SMOOTH_SQL = T_SQL + f""", m AS (SELECT *, count(*) OVER (PARTITION BY bid) AS n, first_value(x) OVER q AS x0, first_value(y) OVER q AS y0, last_value(x) OVER q AS xn, last_value(y) OVER q AS yn FROM t WINDOW q AS (PARTITION BY bid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
pad AS (SELECT bid, frame, time, x, y, n FROM m UNION ALL SELECT bid, 2 - frame, NULL, x0 - abs(x - x0), y0 - abs(y - y0), n FROM m WHERE frame BETWEEN 2 AND 13
  UNION ALL SELECT bid, 2 * n - frame, NULL, xn + abs(x - xn), yn + abs(y - yn), n FROM m WHERE frame BETWEEN n - 12 AND n - 1),
sm AS (SELECT * FROM (SELECT bid, frame, time, n, {weighted("x")} AS x, {weighted("y")} AS y FROM pad WINDOW w AS (PARTITION BY bid ORDER BY frame)) WHERE time IS NOT NULL AND n > 12)"""


@query(f"""WITH {SMOOTH_SQL}, pr AS (SELECT bid, time, x, y, lead(time) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM sm WINDOW w AS (PARTITION BY bid ORDER BY frame)),
gr AS (SELECT bid, tick, x + (tick * 21600.0 - time) / (t2 - time) * (x2 - x) AS x, y + (tick * 21600.0 - time) / (t2 - time) * (y2 - y) AS y FROM pr, unnest(range(CAST(ceil(time / 21600) AS BIGINT), CAST(ceil(t2 / 21600) AS BIGINT))) AS r(tick) WHERE t2 > time),
st AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, tick - lag(tick) OVER w AS dt FROM gr WINDOW w AS (PARTITION BY bid ORDER BY tick))
SELECT bid, tick, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(sqrt(ax * ax + ay * ay) / (dt * 21600), 9) + 0.0 AS speed,
  round(CASE WHEN ax IS NULL OR bx IS NULL THEN NULL WHEN (ax <> 0 OR ay <> 0) AND (bx <> 0 OR by_ <> 0) THEN degrees(atan2(ax * by_ - ay * bx + 0.0, ax * bx + ay * by_)) ELSE 0 END, 3) + 0.0 AS turn FROM st""")
def spaced_paths(spark, sf_dir):
    """Smoothed paths every six hours, with speed and turn."""
    out = centroid.smoothed_and_spaced(observations(spark, sf_dir).select("bid", "frame", "time", "x", "y"), (25, 5), 6 * 3600.0)
    return out.select("bid", "tick", r6("x").alias("x"), r6("y").alias("y"), (F.round("speed", 9) + 0.0).alias("speed"), (F.round("turn", 3) + 0.0).alias("turn"))


@query()
def centroid_paths(spark, sf_dir):
    """The whole package: smoothed, held still in stops, smoothed again, every six hours."""
    path, _ = centroid.centroid_package(observations(spark, sf_dir), least=3, distance=12.0, after=(35, 5), step=6 * 3600.0)
    return path.select("bid", "tick", r6("x").alias("x"), r6("y").alias("y"), (F.round("speed", 9) + 0.0).alias("speed"), (F.round("turn", 3) + 0.0).alias("turn"))


@query()
def centroid_stretches(spark, sf_dir):
    """When objects stood and when they moved, from smoothed positions."""
    _, stretches = centroid.centroid_package(observations(spark, sf_dir), least=3, distance=12.0)
    return stretches.select("bid", *[F.round(c, 6).alias(c) for c in ("start", "end", "seconds")], "moving")


@query()
def spines_in_time(spark, sf_dir):
    """Spines of 21 points smoothed along themselves and over time, on a grid of two days, five times over."""
    rows = poses(spark, sf_dir)
    points = curves.spaced(spines.spine_rows(rows, "spine", "bid", "frame"), 21, ("bid", "frame")).join(rows.select("bid", "frame", "time"), ["bid", "frame"])
    few = rows.groupBy("bid").agg(F.count("*").alias("n")).where("n > 2")
    out = curves.smoothed_in_time(points.join(few.select("bid"), "bid", "left_semi").select("bid", "time", "place", "x", "y"), (7, 3), (5, 2), 2 * 24 * 3600.0)
    return out.select("bid", "tick", "place", r6("x").alias("x"), r6("y").alias("y"))
