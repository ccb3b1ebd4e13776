"""Window and time-series queries over the observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import series
from trackloom.plans.registry import query
from trackloom.sources.tracks import S_SQL, T_SQL, observations, with_segments

r6 = lambda c: F.round(c, 6) + 0.0
KEY = "SELECT bid, frame, "
LAST = "WINDOW w AS (PARTITION BY bid ORDER BY frame)"


@query(f"WITH {T_SQL} {KEY} CASE WHEN time - lag(time) OVER w > 0 THEN round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / (time - lag(time) OVER w), 6) + 0.0 END AS speed FROM t {LAST}")
def speed(spark, sf_dir):
    return series.speed(observations(spark, sf_dir)).select("bid", "frame", r6("speed").alias("speed"))


@query(f"WITH {T_SQL} {KEY} round(sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) / CASE WHEN lead(time) OVER w - time > 1e-7 THEN lead(time) OVER w - time ELSE 1e-7 END, 6) + 0.0 AS speed FROM t {LAST}")
def speed_floor(spark, sf_dir):
    return series.speed_floor(observations(spark, sf_dir)).select("bid", "frame", r6("speed").alias("speed"))


@query(f"""WITH {T_SQL}, d AS (SELECT bid, frame, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM t {LAST})
{KEY} round(atan2(ax * by_ - ay * bx + 0.0, ax * bx + ay * by_), 6) + 0.0 AS angle FROM d""")
def turning_angle(spark, sf_dir):
    return series.turning_angle(observations(spark, sf_dir)).select("bid", "frame", r6("angle").alias("angle"))


@query(f"WITH {T_SQL} {KEY} round(sqrt((x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2), 6) + 0.0 AS displacement FROM t {LAST}")
def absolute_displacement(spark, sf_dir):
    return series.absolute_displacement(observations(spark, sf_dir)).select("bid", "frame", r6("displacement").alias("displacement"))


@query(f"WITH {S_SQL} SELECT bid, frame, CAST(segment AS BIGINT) AS segment FROM s")
def gap_split(spark, sf_dir):
    return with_segments(observations(spark, sf_dir), 14400).select("bid", "frame", "segment")


@query(f"""WITH {T_SQL} {KEY} CASE WHEN count(*) OVER m = 11 THEN round(avg(x) OVER m, 6) + 0.0 END AS smooth FROM t
WINDOW m AS (PARTITION BY bid ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def boxcar11(spark, sf_dir):
    return series.boxcar(observations(spark, sf_dir), "x", 11).select("bid", "frame", r6("smooth").alias("smooth"))


@query(f"""WITH {T_SQL}, m AS ({KEY} CASE WHEN count(*) OVER m = 11 THEN avg(x) OVER m END AS smooth FROM t WINDOW m AS (PARTITION BY bid ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
{KEY} round(coalesce(first_value(smooth IGNORE NULLS) OVER (PARTITION BY bid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(smooth IGNORE NULLS) OVER (PARTITION BY bid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS smooth FROM m""")
def smooth_filled(spark, sf_dir):
    return series.fill_edges(series.boxcar(observations(spark, sf_dir), "x", 11), "smooth").select("bid", "frame", r6("smooth").alias("smooth"))


@query(f"""WITH {T_SQL} {KEY} coalesce(count(*) OVER (PARTITION BY bid) >= 23.1 AND CASE WHEN stddev_pop(x) OVER m > 0 THEN abs(x - avg(x) OVER m) / stddev_pop(x) OVER m > 2.3263 END, false) AS outlier FROM t
WINDOW m AS (PARTITION BY bid ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def rolling_outlier_once(spark, sf_dir):
    return series.rolling_outliers(observations(spark, sf_dir), "x").select("bid", "frame", "outlier")


GOOD = "SELECT bid, frame, time, x >= 20 AS good FROM t"
ISLANDS = f"""g AS ({GOOD}), i AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY frame) - row_number() OVER (PARTITION BY bid, good ORDER BY frame) AS island FROM g)"""


def _good(spark, sf_dir):
    return observations(spark, sf_dir).select("bid", "frame", "time", (F.col("x") >= 20).alias("good"))


@query(f"WITH {T_SQL}, {ISLANDS} {KEY} CASE WHEN good THEN count(*) OVER (PARTITION BY bid, good, island) ELSE 0 END AS run FROM i")
def run_length(spark, sf_dir):
    return series.run_lengths(_good(spark, sf_dir), "good").select("bid", "frame", "run")


@query(f"WITH {T_SQL}, {ISLANDS} {KEY} good AND count(*) OVER (PARTITION BY bid, good, island) >= 4 AS ok FROM i")
def trouble_areas(spark, sf_dir):
    return series.keep_long_runs(_good(spark, sf_dir), "good", 4).select("bid", "frame", "ok")


@query(f"""WITH {T_SQL}, g AS ({GOOD}) {KEY} good OR (count(*) OVER m = 5 AND avg(CAST(good AS INT)) OVER m >= 0.7) AS ok FROM g
WINDOW m AS (PARTITION BY bid ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def loner_flags(spark, sf_dir):
    return series.forgive_loners(_good(spark, sf_dir), "good", 5).select("bid", "frame", "ok")


@query(f"""WITH {T_SQL}, {ISLANDS} SELECT bid, min(time) AS start, max(time) AS "end" FROM i WHERE NOT good GROUP BY bid, island HAVING max(time) > min(time)""")
def break_intervals(spark, sf_dir):
    return series.bad_intervals(_good(spark, sf_dir), "good")


@query(f"""WITH {T_SQL}, a AS (SELECT bid, frame, x / 10 - lag(x / 10) OVER w AS d FROM t {LAST}), b AS (SELECT bid, frame, coalesce(d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi(), 0) AS turn FROM a)
{KEY} round(sum(turn) OVER w, 5) + 0.0 AS unwrapped FROM b {LAST}""")
def unwrap_angle(spark, sf_dir):
    df = observations(spark, sf_dir).withColumn("angle", F.col("x") / 10)
    return series.unwrap_angle(df, "angle").select("bid", "frame", (F.round("unwrapped", 5) + 0.0).alias("unwrapped"))


CONVERGE = f"""{T_SQL}, c AS (SELECT bid, frame, time, avg(x) OVER w AS running, avg(x) OVER (PARTITION BY bid) AS final FROM t {LAST}),
d AS (SELECT *, CASE WHEN final <> 0 THEN 100 * abs(running - final) / abs(final) END AS error FROM c),
k AS (SELECT *, max(error) OVER (PARTITION BY bid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM d)"""


@query(f"WITH {CONVERGE} {KEY} round(running, 5) + 0.0 AS running, round(error, 5) + 0.0 AS error, round(worst, 5) + 0.0 AS worst FROM k")
def convergence(spark, sf_dir):
    out = series.convergence(observations(spark, sf_dir), "x")
    return out.select("bid", "frame", *[(F.round(c, 5) + 0.0).alias(c) for c in ("running", "error", "worst")])


@query(f"WITH {CONVERGE}, p AS (SELECT unnest([5, 10, 20]) AS percent) SELECT bid, percent, min(time) AS crossing FROM k, p WHERE worst < percent GROUP BY bid, percent")
def crossing_time(spark, sf_dir):
    levels = F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("percent")
    out = series.convergence(observations(spark, sf_dir), "x").select("bid", "time", "worst", levels)
    return out.where("worst < percent").groupBy("bid", "percent").agg(F.min("time").alias("crossing"))


BINS = "CAST(floor((time - t_first) / size) AS BIGINT) AS bin, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(median(x), 6) + 0.0 AS median, round(stddev_samp(x), 6) + 0.0 AS std"


def _characterise(df, *keys):
    return df.groupBy(*keys, "bin").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.median("x")).alias("median"), r6(F.stddev_samp("x")).alias("std"))


@query(f"WITH {T_SQL}, f AS (SELECT *, min(time) OVER () AS t_first, 86400 AS size FROM t) SELECT {BINS} FROM f GROUP BY 1")
def bins_tumbling(spark, sf_dir):
    df = observations(spark, sf_dir)
    df = df.crossJoin(F.broadcast(df.agg(F.min("time").alias("t_first"))))  # one row
    return _characterise(series.tumbling_bins(df, 86400, F.col("t_first")))


@query(f"WITH {T_SQL}, f AS (SELECT *, min(time) OVER () AS t_first, unnest([21600, 43200, 86400]) AS size FROM t) SELECT size, {BINS} FROM f GROUP BY 1, 2 HAVING count(*) >= 30")
def bin_sweep(spark, sf_dir):
    df = observations(spark, sf_dir)
    df = df.crossJoin(F.broadcast(df.agg(F.min("time").alias("t_first")))).withColumn("size", F.explode(F.array(*map(F.lit, (21600, 43200, 86400)))))
    return _characterise(df.withColumn("bin", F.floor((F.col("time") - F.col("t_first")) / F.col("size"))), "size").where("n >= 30")


@query(f"WITH {T_SQL} SELECT bid, CAST(floor(time / 3600) AS BIGINT) AS frame, round(sum(x * area) / sum(area), 6) + 0.0 AS x, round(sum(y * area) / sum(area), 6) + 0.0 AS y, sum(area) AS area, count(*) AS parts FROM t GROUP BY 1, 2")
def dup_frame_curation(spark, sf_dir):
    df = observations(spark, sf_dir).withColumn("frame", F.floor(F.col("time") / 3600))
    return series.merge_duplicate_frames(df).select("bid", "frame", r6("x").alias("x"), r6("y").alias("y"), "area", "parts")


@query(f"""WITH {T_SQL}, p AS (SELECT bid, time, x, y, lead(time) OVER o AS t2, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM t WINDOW o AS (PARTITION BY bid ORDER BY time)),
g AS (SELECT *, unnest(range(CAST(ceil(time / 3600) AS BIGINT), CAST(ceil(t2 / 3600) AS BIGINT))) AS tick FROM p WHERE t2 > time)
SELECT bid, tick, round(x + (tick * 3600 - time) / (t2 - time) * (x2 - x), 6) + 0.0 AS x, round(y + (tick * 3600 - time) / (t2 - time) * (y2 - y), 6) + 0.0 AS y FROM g""")
def interp_grid(spark, sf_dir):
    out = series.interpolate_grid(observations(spark, sf_dir), 3600, ["x", "y"])
    return out.select("bid", "tick", r6("x").alias("x"), r6("y").alias("y"))
