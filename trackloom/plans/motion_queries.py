"""Speed pipeline and behaviour queries over the observations' segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import motion
from trackloom.operators.batches import in_tasks
from trackloom.plans.registry import query
from trackloom.sources.tracks import S_SQL, T_SQL, observations, with_segments

#: The observations are minutes to hours apart, so the unit of time is a quarter of an hour here.
UNIT, WIDTH = 900.0, 3
PAUSE = 4 * 3600
r6 = lambda c: F.round(c, 6) + 0.0


#: Observations of a task; speeds make about twenty rows of each.
OBSERVATIONS = 20_000


def segments(spark, sf_dir):
    rows = observations(spark, sf_dir, lambda events: in_tasks(events, events.count(), OBSERVATIONS, "bid"))
    return with_segments(rows, PAUSE)


P = "PARTITION BY bid, segment ORDER BY time"
FILLED = f"""l AS (
  SELECT *, lead(time) OVER w AS time2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, CAST(floor((lead(time) OVER w - time) / {UNIT}) AS BIGINT) * 10 AS n FROM s WINDOW w AS ({P})
), f AS (
  SELECT bid, segment, time, x, y FROM l WHERE coalesce(time2 - time <= {UNIT}, true)
  UNION ALL
  SELECT bid, segment, time + i / (n - 1) * (time2 - time), x + i / (n - 1) * (x2 - x), y + i / (n - 1) * (y2 - y) FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM l WHERE time2 - time > {UNIT})
)"""


def smooth_sql(c: str) -> str:
    half = WIDTH // 2
    return f"(sum({c}) OVER m + greatest({half} + 1 - n, 0) * first_value({c}) OVER a + greatest(n + {half} - total, 0) * last_value({c}) OVER a) / {WIDTH} AS {c}"


SMOOTH = f"""k AS (SELECT *, row_number() OVER ({P}) AS n, count(*) OVER (PARTITION BY bid, segment) AS total FROM f), b AS (
  SELECT bid, segment, time, {smooth_sql('x')}, {smooth_sql('y')} FROM k
  WINDOW m AS ({P} ROWS BETWEEN {WIDTH // 2} PRECEDING AND {WIDTH // 2} FOLLOWING), a AS ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)"""
GRID = f"""h AS (SELECT *, lead(time) OVER w AS time2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM b WINDOW w AS ({P})), g AS (
  SELECT bid, segment, tick, x + (tick * {UNIT} - time) / (time2 - time) * (x2 - x) AS x, y + (tick * {UNIT} - time) / (time2 - time) * (y2 - y) AS y
  FROM (SELECT *, unnest(range(CAST(ceil(time / {UNIT}) AS BIGINT), CAST(ceil(time2 / {UNIT}) AS BIGINT))) AS tick FROM h WHERE time2 > time)
), v0 AS (
  SELECT * FROM (SELECT bid, segment, tick, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / (tick - lag(tick) OVER w) AS speed FROM g WINDOW w AS (PARTITION BY bid, segment ORDER BY tick)) WHERE speed IS NOT NULL
)"""


def outlier_sql(k: int) -> str:
    return f"""v{k + 1} AS (SELECT bid, segment, tick, speed FROM (
  SELECT *, avg(speed) OVER m AS mean, stddev_pop(speed) OVER m AS spread, row_number() OVER (PARTITION BY bid, segment ORDER BY tick) AS i, count(*) OVER (PARTITION BY bid, segment) AS n FROM v{k}
  WINDOW m AS (PARTITION BY bid, segment ORDER BY tick ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)
) WHERE NOT (abs(speed - mean) > 2.3263 * spread AND spread > 0 AND n >= 12 AND i > 5 AND i <= n - 5))"""


SPEED = f"{S_SQL}, {FILLED}, {SMOOTH}, {GRID}, " + ", ".join(map(outlier_sql, range(3)))


@query(f"WITH {S_SQL}, {FILLED} SELECT bid, segment, round(time, 3) + 0.0 AS time, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM f")
def filled_gaps(spark, sf_dir):
    return motion.fill_long_gaps(segments(spark, sf_dir), UNIT, ["x", "y"]).select("bid", "segment", (F.round("time", 3) + 0.0).alias("time"), r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {S_SQL}, f AS (SELECT * FROM s), {SMOOTH} SELECT bid, segment, time, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM b")
def padded_smooth(spark, sf_dir):
    return motion.padded_boxcar(segments(spark, sf_dir), ["x", "y"], WIDTH).select("bid", "segment", "time", r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {SPEED} SELECT bid, segment, tick, round(speed, 6) + 0.0 AS speed FROM v0")
def segment_speed(spark, sf_dir):
    return motion.segment_speed(segments(spark, sf_dir), UNIT, WIDTH, remove_outliers=False).select("bid", "segment", "tick", r6("speed").alias("speed"))


@query(f"WITH {SPEED} SELECT bid, segment, tick, round(speed, 6) + 0.0 AS speed FROM v3")
def speed_without_outliers(spark, sf_dir):
    raw = motion.segment_speed(segments(spark, sf_dir), UNIT, WIDTH, remove_outliers=False)
    return motion.drop_outliers(raw, "speed", rounds=3, least_rows=12).select("bid", "segment", "tick", r6("speed").alias("speed"))


@query(f"WITH {SPEED} SELECT bid, segment, tick, round(speed, 6) + 0.0 AS speed FROM v0 WHERE bid IN (SELECT bid FROM v0 GROUP BY bid HAVING max(speed) <= 20)")
def speed_of_slow(spark, sf_dir):
    return motion.slow_enough(motion.segment_speed(segments(spark, sf_dir), UNIT, WIDTH, remove_outliers=False), 20).select("bid", "segment", "tick", r6("speed").alias("speed"))


@query(f"WITH {S_SQL} SELECT bid, segment, frame FROM s WHERE time >= 86400 WINDOW w AS (PARTITION BY bid, segment) QUALIFY count(*) OVER w >= 3 AND max(time) OVER w - min(time) OVER w > 3600")
def tracks_for_analysis(spark, sf_dir):
    return motion.long_segments(segments(spark, sf_dir), 3, 3600, start=86400).select("bid", "segment", "frame")


@query(f"""WITH {T_SQL}, a AS (SELECT bid, time, x, (time - min(time) OVER w) / 86400.0 AS place, floor((max(time) OVER w - min(time) OVER w) / 86400.0) AS parts FROM t WINDOW w AS (PARTITION BY bid)),
b AS (SELECT *, CAST(floor(place) AS BIGINT) AS part FROM a UNION ALL SELECT *, CAST(floor(place) AS BIGINT) - 1 FROM a WHERE place = floor(place) AND place > 0)
SELECT bid, part, count(x) AS n, round(avg(x), 6) + 0.0 AS loc, round(stddev_pop(x), 6) + 0.0 AS scale, min(time) AS t0, max(time) AS "tN" FROM b WHERE part < parts GROUP BY bid, part""")
def whole_windows(spark, sf_dir):
    return motion.whole_windows(observations(spark, sf_dir), 86400.0, "x").select("bid", "part", "n", r6("loc").alias("loc"), r6("scale").alias("scale"), "t0", "tN")


TURN = "((({0}) + pi()) - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi())"


@query(f"""WITH {S_SQL}, p AS (SELECT *, atan2(x - 50, y - 50) AS facing, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, time - lag(time) OVER w AS dt, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS move_or FROM s WINDOW w AS (PARTITION BY bid, segment ORDER BY frame)),
q AS (SELECT *, coalesce({TURN.format('facing - lag(facing) OVER w')}, 0.0) AS turn FROM p WINDOW w AS (PARTITION BY bid, segment ORDER BY frame)),
o AS (SELECT *, first_value(facing) OVER w + sum(turn) OVER w AS orientation FROM q WINDOW w AS (PARTITION BY bid, segment ORDER BY frame))
SELECT bid, frame, round(move_or, 6) + 0.0 AS move_or, round(orientation, 6) + 0.0 AS orientation, round(CASE WHEN dt <> 0 THEN d / dt / 2 END, 6) + 0.0 AS speed,
round(CASE WHEN dt <> 0 THEN d / dt END * cos(orientation - move_or), 6) + 0.0 AS speed_along, round(CASE WHEN dt <> 0 THEN d / dt END * sin(orientation - move_or), 6) + 0.0 AS speed_perp,
round(CASE WHEN dt <> 0 THEN (orientation - lag(orientation) OVER w) / dt END, 6) + 0.0 AS angular_v, round(area / (area + y), 6) + 0.0 AS ar, round(time / 60, 3) + 0.0 AS minutes FROM o WINDOW w AS (PARTITION BY bid, segment ORDER BY frame)""")
def behaviour(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumns({"len_x": F.col("y") - 50, "len_y": F.col("x") - 50, "width": F.col("area"), "length": F.col("area") + F.col("y")})
    out = motion.behaviour(rows, 2.0)
    return out.select("bid", "frame", *[r6(c).alias(c) for c in ("move_or", "orientation", "speed", "speed_along", "speed_perp", "angular_v", "ar")], (F.round("minutes", 3) + 0.0).alias("minutes"))


@query(f"WITH {T_SQL} SELECT bid, frame, abs(area - avg(area) OVER w) < 2 * stddev_pop(area) OVER w AS usual FROM t WINDOW w AS (PARTITION BY bid)")
def usual_lengths(spark, sf_dir):
    return motion.usual_lengths(observations(spark, sf_dir), "area").select("bid", "frame", "usual")


INTERVALS = """i AS (SELECT bid, min(time) FILTER (WHERE flag) AS start, max(time) FILTER (WHERE NOT flag AND run = ends) AS "end" FROM (
  SELECT bid, time, flag, run, run AS ends FROM r WHERE flag UNION ALL SELECT bid, time, flag, run - 1, run - 1 FROM r WHERE NOT flag) GROUP BY bid, run HAVING min(time) FILTER (WHERE flag) IS NOT NULL AND max(time) FILTER (WHERE NOT flag) IS NOT NULL)"""
RUNS = "r AS (SELECT bid, time, x < 40 AS flag, sum(CAST(NOT x < 40 AS INT)) OVER (PARTITION BY bid ORDER BY frame) AS run FROM t)"


@query(f'WITH {T_SQL}, {RUNS}, {INTERVALS} SELECT bid, start, "end" FROM i')
def true_intervals(spark, sf_dir):
    return motion.true_intervals(observations(spark, sf_dir), F.col("x") < 40)


@query(f'WITH {T_SQL}, {RUNS}, {INTERVALS} SELECT t.bid, frame, start, "end" FROM t JOIN i ON i.bid = t.bid AND time >= start AND time < "end"')
def inside_intervals(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return motion.inside_intervals(rows, motion.true_intervals(rows, F.col("x") < 40)).select("bid", "frame", "start", "end")
