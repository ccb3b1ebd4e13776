"""Queries of flags, smoothing windows, resampling and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import curves, flags
from trackloom.plans.registry import query
from trackloom.plans.motion_queries import segments
from trackloom.sources.tracks import S_SQL, T_SQL, observations, table

r6 = lambda c: F.round(c, 6) + 0.0


@query(f"""WITH {T_SQL}, m AS (SELECT bid, min(x) AS low, max(x) AS high FROM t GROUP BY bid) SELECT bid, CAST(least(floor((x - low) / ((high - low) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM t JOIN m USING (bid) GROUP BY 1, 2""")
def histogram_by_object(spark, sf_dir):
    return flags.histogram(observations(spark, sf_dir), "x", 20, ["bid"]).select("bid", "bin", "n")


@query()
def outlier_flags(spark, sf_dir):
    return flags.outlier_flags(observations(spark, sf_dir), "x").select("bid", "frame", "ok_short", "ok_long", "ok")


@query(f"WITH {T_SQL}, f AS (SELECT bid, x > 5 AS a, y > 5 AS b, area < 90 AS c FROM t) SELECT bid, count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (a AND b AND c) AS every FROM f GROUP BY bid")
def flag_report(spark, sf_dir):
    rows = observations(spark, sf_dir).select("bid", (F.col("x") > 5).alias("a"), (F.col("y") > 5).alias("b"), (F.col("area") < 90).alias("c"))
    return flags.flag_counts(rows.withColumn("every", flags.all_flags("a", "b", "c")), ["a", "b", "every"])


HANN = flags.WINDOWS["hann"](7)
HANN_SQL = " + ".join(f"{float(c / HANN.sum())!r} * " + ("x" if k == 0 else f"{'lag' if k < 0 else 'lead'}(x, {abs(k)}) OVER w") for k, c in zip(range(-3, 4), HANN))


@query(f"WITH {T_SQL} SELECT bid, frame, round({HANN_SQL}, 6) + 0.0 AS smooth FROM t WINDOW w AS (PARTITION BY bid ORDER BY frame)")
def window_smooth(spark, sf_dir):
    return flags.window_smooth(observations(spark, sf_dir), "x", "hann", 7).select("bid", "frame", r6("smooth").alias("smooth"))


@query(f"""WITH {S_SQL}, r AS (SELECT *, sum(d) OVER (PARTITION BY bid, segment ORDER BY frame) AS run, sum(d) OVER (PARTITION BY bid, segment) AS total FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM s WINDOW w AS (PARTITION BY bid, segment ORDER BY frame))),
k AS (SELECT bid, segment, i AS place, CASE WHEN i = 10 THEN total ELSE total * i / 10 END AS target FROM (SELECT bid, segment, max(run) AS total FROM r GROUP BY bid, segment HAVING max(run) > 0), unnest(range(11)) AS q(i)),
g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(run) OVER w AS run2 FROM r WINDOW w AS (PARTITION BY bid, segment ORDER BY frame)),
a AS (SELECT k.*, g.x, g.y, g.run, g.x2, g.y2, g.run2 FROM k JOIN g ON k.bid = g.bid AND k.segment = g.segment AND k.target >= g.run AND (k.target < g.run2 OR g.run2 IS NULL))
SELECT bid, CAST(segment AS BIGINT) AS segment, CAST(place AS INT) AS place, round(CASE WHEN x2 IS NULL THEN x ELSE x + (target - run) / (run2 - run) * (x2 - x) END, 6) + 0.0 AS x, round(CASE WHEN y2 IS NULL THEN y ELSE y + (target - run) / (run2 - run) * (y2 - y) END, 6) + 0.0 AS y FROM a""")
def resampled_paths(spark, sf_dir):
    out = curves.spaced(segments(spark, sf_dir).select("bid", "segment", "frame", "x", "y"), 11, ("bid", "segment"), "frame")
    return out.select("bid", "segment", F.col("frame").cast("int").alias("place"), r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {T_SQL}, m AS (SELECT bid, floor(time / 86400) AS m, avg(x) AS v FROM t GROUP BY 1, 2) SELECT bid, round(-regr_slope(ln(v), m), 6) + 0.0 AS rate, round(exp(regr_intercept(ln(v), m)), 4) + 0.0 AS start, count(*) AS n FROM m WHERE v > 0 GROUP BY bid")
def decay_fit(spark, sf_dir):
    out = flags.decay_fit(observations(spark, sf_dir).withColumn("day", F.col("time") / 86400), "x", "day", "bid")
    return out.select("bid", r6("rate").alias("rate"), (F.round("start", 4) + 0.0).alias("start"), "n")


@query("""WITH o AS (SELECT l_suppkey AS image, quantile_cont(l_extendedprice, 0.05) AS dark FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), g AS (SELECT l_suppkey AS image, avg(l_extendedprice) AS ground FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT image, round(dark, 4) AS dark, round(ground, 4) AS ground, round(ground - dark, 4) AS contrast FROM o JOIN g USING (image)""")
def image_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_extendedprice").alias("value"), "l_returnflag")
    out = flags.image_scores(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag != 'R'"), "image")
    return out.select("image", *[F.round(c, 4).alias(c) for c in ("dark", "ground", "contrast")])


@query(f"WITH {T_SQL} SELECT bid, min(frame) AS head_frame, arg_min(x, frame) AS head_x, max(frame) AS tail_frame, arg_max(x, frame) AS tail_x FROM t GROUP BY bid")
def head_and_tail(spark, sf_dir):
    return flags.head_and_tail(observations(spark, sf_dir), "frame", "bid", ["x"])


@query(f"WITH {T_SQL} SELECT bid, frame, sum(CAST(kind = 'click' AS INT)) OVER (PARTITION BY bid ORDER BY frame) % 2 = 1 AS flipped FROM t")
def flip_parity(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("flip", F.col("kind") == "click")
    return rows.select("bid", "frame", flags.flip_parity("flip").alias("flipped"))
