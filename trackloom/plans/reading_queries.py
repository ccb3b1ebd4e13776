"""Queries of the readings of tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import readings
from trackloom.plans.registry import query
from trackloom.sources.tracks import T_SQL, observations, table, tracks

r6 = lambda c: F.round(c, 6) + 0.0
W = "WINDOW w AS (PARTITION BY bid ORDER BY frame)"
STEP = "sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2)"


@query(f"WITH {T_SQL} SELECT bid, frame FROM t WHERE time BETWEEN 86400 AND 864000 AND kind <> 'view'")
def time_range(spark, sf_dir):
    return readings.in_time_range(observations(spark, sf_dir), 86400, 864000, F.col("kind") == "view").select("bid", "frame")


@query(f"WITH {T_SQL} SELECT bid, frame, x FROM t WHERE area > 40")
def unflagged(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return readings.unflagged(rows, rows.select("bid", "frame", (F.col("area") > 40).alias("flag"))).select("bid", "frame", "x")


@query(f"WITH {T_SQL} SELECT bid, count(*) AS n, max(time) - min(time) AS duration FROM t GROUP BY bid HAVING count(*) >= 60 AND max(time) - min(time) >= 86400")
def eligible_tracks(spark, sf_dir):
    return readings.eligible(observations(spark, sf_dir), 60, 86400)


@query(f"WITH {T_SQL}, a AS (SELECT bid, median(area) AS area FROM t GROUP BY bid) SELECT median(a.area) AS area FROM t JOIN a USING (bid) WHERE kind = 'click'")
def typical_area(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return readings.typical_value(rows.groupBy("bid").agg(F.median("area").alias("area")), rows.where("kind = 'click'"), "area")


@query(f"WITH {T_SQL} SELECT bid, round(time, 1) AS time, x, NULL AS y FROM t WHERE kind = 'click' UNION ALL SELECT bid, round(time, 1), NULL, y FROM t WHERE kind = 'view'")
def common_series(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return readings.common_series([rows.where("kind = 'click'").select("bid", "time", "x"), rows.where("kind = 'view'").select("bid", "time", "y")])


@query(f"""WITH {T_SQL}, d AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, time - lag(time) OVER w AS dt FROM t {W}),
v AS (SELECT bid, sqrt(ax ** 2 + ay ** 2) AS step, CASE WHEN dt <> 0 THEN sqrt(ax ** 2 + ay ** 2) / dt END AS speed, abs(atan2(ax * by_ - ay * bx + 0.0, ax * bx + ay * by_)) AS turn FROM d)
SELECT bid, round(sum(step), 5) + 0.0 AS length, round(avg(speed), 5) + 0.0 AS mean_speed, round(median(speed), 5) + 0.0 AS median_speed, round(avg(turn), 5) + 0.0 AS mean_turn, round(median(turn), 5) + 0.0 AS median_turn, round(sum(turn), 5) + 0.0 AS turned FROM v GROUP BY bid""")
def track_statistics(spark, sf_dir):
    out = readings.track_statistics(observations(spark, sf_dir))
    return out.select("bid", *[(F.round(c, 5) + 0.0).alias(c) for c in out.columns if c != "bid"])


@query(f"WITH {T_SQL}, d AS (SELECT bid, {STEP} AS s FROM t {W}) SELECT bid, count(s) AS n, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS deviation, round(max(s), 6) + 0.0 AS largest FROM d GROUP BY bid")
def step_noise(spark, sf_dir):
    return readings.step_noise(observations(spark, sf_dir)).select("bid", "n", *[r6(c).alias(c) for c in ("mean", "deviation", "largest")])


WIDTHS = [3, 7, 15, 31]


@query(f"WITH {T_SQL}" + "".join(f", s{n} AS (SELECT abs(x - CASE WHEN count(*) OVER m = {n} THEN avg(x) OVER m END) AS e FROM t WINDOW m AS (PARTITION BY bid ORDER BY frame ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING))" for n in WIDTHS) + " " + " UNION ALL ".join(f"SELECT {n} AS width, count(e) AS n, round(avg(e), 6) + 0.0 AS error FROM s{n}" for n in WIDTHS))
def window_sweep(spark, sf_dir):
    return readings.sweep(observations(spark, sf_dir), "x", WIDTHS).select("width", "n", r6("error").alias("error"))


@query(f"""WITH {T_SQL}, k AS (SELECT bid, time, x, CAST(ceil((time - min(time) OVER (PARTITION BY bid)) / 86400) AS BIGINT) AS tick FROM t), f AS (SELECT bid, tick, x FROM k WHERE tick <= 20 QUALIFY row_number() OVER (PARTITION BY bid, tick ORDER BY time) = 1),
g AS (SELECT b.bid, i AS tick, coalesce((SELECT arg_min(f.x, f.tick) FROM f WHERE f.bid = b.bid AND f.tick >= i), (SELECT arg_max(f.x, f.tick) FROM f WHERE f.bid = b.bid)) AS x FROM (SELECT DISTINCT bid FROM f) b, (SELECT unnest(range(0, 21)) AS i))
SELECT tick, count(x) AS n, round(avg(x), 6) + 0.0 AS mean FROM g GROUP BY tick""")
def compiled_curves(spark, sf_dir):
    return readings.compiled_curves(observations(spark, sf_dir), "x", 86400, 20).select("tick", "n", r6("mean").alias("mean"))


@query(f"WITH {T_SQL} SELECT bid, frame FROM t WHERE frame < 10 OR frame >= 20")
def excised_frames(spark, sf_dir):
    return readings.without_frames(observations(spark, sf_dir), 10, 20).select("bid", "frame")


@query(f"WITH {T_SQL} SELECT bid, frame FROM t WHERE (frame - 1) % 10 = 0 AND bid IN (SELECT bid FROM t GROUP BY bid HAVING count(*) > 50)")
def every_tenth(spark, sf_dir):
    return readings.every_nth(observations(spark, sf_dir), 10, 50).select("bid", "frame")


@query(f"""WITH {T_SQL}, m AS (SELECT bid, frame, k AS point, x + k AS x, y - k AS y FROM t, (SELECT unnest(range(0, 11)) AS k) WHERE kind <> 'view')
SELECT bid, frame, point, round(avg(x) OVER n, 6) + 0.0 AS x, round(avg(y) OVER n, 6) + 0.0 AS y FROM m WINDOW n AS (PARTITION BY bid, point ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def smooth_midlines(spark, sf_dir):
    """Midlines of eleven points beside each position; those of views are one point short and left out."""
    line = F.transform(F.sequence(F.lit(0), F.when(F.col("kind") == "view", 9).otherwise(10)), lambda k: F.struct((F.col("x") + k).alias("x"), (F.col("y") - k).alias("y")))
    points = readings.midline_points(observations(spark, sf_dir).withColumn("midline", line), "midline", ["bid", "frame"])
    return readings.smooth_midlines(points, 5).select("bid", "frame", "point", r6("x").alias("x"), r6("y").alias("y"))


LEVELS = [0.0, 100.0, 130.0]


@query(f"""WITH {T_SQL}, b AS (SELECT bid, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS moved, count(*) AS n, count(*) FILTER (WHERE area > 50) AS good FROM t GROUP BY bid)
SELECT least, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, round(sum(good) / sum(n), 6) + 0.0 AS share FROM b, (SELECT unnest({LEVELS}) AS least) WHERE moved >= least GROUP BY least""")
def accuracy_of_moved(spark, sf_dir):
    return readings.accuracy_of_moved(observations(spark, sf_dir), LEVELS, F.col("area") > 50).withColumn("share", r6("share"))


@query(f"WITH {T_SQL} SELECT bid, frame, round(asinh(x / 0.1), 6) + 0.0 AS value FROM t WHERE frame > 1")
def state_input(spark, sf_dir):
    return readings.state_input(observations(spark, sf_dir), "x").select("bid", "frame", r6("value").alias("value"))


@query("SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number FROM part WHERE p_type IS NOT NULL UNION ALL SELECT s_suppkey, TRY_CAST(s_name AS BIGINT) FROM supplier")
def combined_sheets(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p_partkey"), F.col("p_type").alias("kind"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand"))
    others = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit("s").alias("kind"), F.col("s_name").alias("brand"))
    return readings.combined_sheets([parts, others], {"brand": "number"}, "kind", "number").select("p_partkey", "number")
