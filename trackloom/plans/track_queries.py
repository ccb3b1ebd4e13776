"""Filter, join, aggregate, sort and set queries over observations and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import gaps
from trackloom.operators import tracks as op
from trackloom.operators.stats import exact_quantiles
from trackloom.plans.registry import query
from trackloom.sources.tracks import N_SQL, T_SQL, observations, table, tracks

r6 = lambda c: F.round(c, 6) + 0.0
BOX = "min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max"
HEXAGON = [(10, 10), (60, 5), (95, 40), (80, 90), (30, 85), (5, 50)]
POLYGON_SQL = " + ".join(
    f"CAST((({float(ay)} > cy) <> ({float(by)} > cy)) AND cx < ({bx - ax}) * (cy - {ay}) / ({float(by - ay)}) + {ax} AS INT)"
    for (ax, ay), (bx, by) in zip(HEXAGON, HEXAGON[1:] + HEXAGON[:1])
)
CENTRE = "centre AS (SELECT node_id, (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy FROM n)"


@query(f"WITH {T_SQL} SELECT bid, {BOX} FROM t GROUP BY bid")
def bounds(spark, sf_dir):
    return op.bounds(observations(spark, sf_dir))


@query(f"WITH {T_SQL} SELECT bid, median(area) AS area_median FROM t GROUP BY bid")
def sizes(spark, sf_dir):
    return op.sizes(observations(spark, sf_dir))


@query(f"WITH {T_SQL} SELECT bid, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, min(time) AS t0, min(frame) AS f0, arg_max(x, frame) AS \"xN\", arg_max(y, frame) AS \"yN\", max(time) AS \"tN\", max(frame) AS \"fN\" FROM t GROUP BY bid")
def terminals(spark, sf_dir):
    return op.terminals(observations(spark, sf_dir))


@query(f"""WITH {T_SQL}, d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM t WINDOW w AS (PARTITION BY bid ORDER BY frame))
SELECT bid, median(area) AS area_median, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS diagonal, round(coalesce(sum(step), 0), 6) AS path,
  round(sqrt((arg_max(x, frame) - arg_min(x, frame)) ** 2 + (arg_max(y, frame) - arg_min(y, frame)) ** 2), 6) AS end_to_end, max(time) - min(time) AS duration FROM d GROUP BY bid""")
def basic_properties(spark, sf_dir):
    out = op.basic_properties(observations(spark, sf_dir))
    return out.select("bid", "area_median", *[r6(c).alias(c) for c in ("diagonal", "path", "end_to_end")], "duration")


@query(f"""WITH {N_SQL} SELECT count(*) AS tracks, CAST(sum(n) AS BIGINT) AS rows_in, round(avg(tN - t0), 6) AS mean_life, max(tN - t0) AS longest, round(avg((x_max - x_min) + (y_max - y_min)), 6) AS mean_extent,
  count(*) FILTER ((x_max - x_min) + (y_max - y_min) >= 10) AS moving FROM n""")
def cleanup_report(spark, sf_dir):
    """The flagship: observations to tracks to a report on their lives and movement."""
    life, extent = F.col("tN") - F.col("t0"), (F.col("x_max") - F.col("x_min")) + (F.col("y_max") - F.col("y_min"))  # in the SQL's order: an extent may be 10 but for rounding
    return tracks(spark, sf_dir).agg(F.count("*").alias("tracks"), F.sum("n").alias("rows_in"), r6(F.avg(life)).alias("mean_life"), F.max(life).alias("longest"), r6(F.avg(extent)).alias("mean_extent"), F.count_if(extent >= 10).alias("moving"))


@query(f"WITH {N_SQL} SELECT node_id FROM n WHERE area_median >= 20 AND tN - t0 >= 3600 AND sqrt((x_max - x_min) ** 2 + (y_max - y_min) ** 2) / 10 >= 1")
def worthy_tracks(spark, sf_dir):
    return op.worthy(tracks(spark, sf_dir), 20, 3600, 1, F.lit(10.0)).select("node_id")


@query(f"WITH {N_SQL}, {CENTRE} SELECT node_id, sqrt((cx - 50) ** 2 + (cy - 50) ** 2) < 30 AS inside FROM centre")
def roi_circle(spark, sf_dir):
    return tracks(spark, sf_dir).select("node_id", op.inside_circle(*op.centre(), 50, 50, 30).alias("inside"))


@query(f"WITH {N_SQL}, {CENTRE} SELECT node_id, ({POLYGON_SQL}) % 2 = 1 AS inside FROM centre")
def roi_polygon(spark, sf_dir):
    return tracks(spark, sf_dir).select("node_id", op.inside_polygon(*op.centre(), HEXAGON).alias("inside"))


@query(f"""WITH {N_SQL}, l AS (SELECT median(area_median) AS typical FROM n) SELECT node_id, round((x_max - x_min + y_max - y_min) / typical, 6) AS moved FROM n, l WHERE (x_max - x_min + y_max - y_min) / typical >= 1""")
def moved_manhattan(spark, sf_dir):
    nodes = tracks(spark, sf_dir)
    typical = exact_quantiles(nodes, "area_median", [0.5]).select(F.col("value").alias("typical"))  # one row
    return op.moved_manhattan(nodes.crossJoin(F.broadcast(typical)), F.col("typical")).where("moved >= 1").select("node_id", r6("moved").alias("moved"))


@query(f"WITH {T_SQL} SELECT bid, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / median(area), 6) AS moved FROM t GROUP BY bid")
def moved_diagonal(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return op.moved_diagonal(op.bounds(obs), op.sizes(obs)).select("bid", r6("moved").alias("moved"))


@query(f"WITH {N_SQL} SELECT node_id FROM n WHERE t0 <= 900000 AND tN >= 600000")
def time_overlap(spark, sf_dir):
    return op.alive_between(tracks(spark, sf_dir), 600000, 900000).select("node_id")


@query(f"WITH {N_SQL} SELECT node_id FROM n WHERE bid NOT IN (SELECT bid FROM t WHERE kind = 'purchase')")
def blank_nodes(spark, sf_dir):
    seen = observations(spark, sf_dir).where("kind = 'purchase'").select("bid")
    return tracks(spark, sf_dir).join(seen, "bid", "left_anti").select("node_id")


@query(f"WITH {T_SQL} SELECT bid, {BOX}, median(area) AS area_median FROM t GROUP BY bid")
def bounds_sizes_inner(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return op.bounds(obs).join(op.sizes(obs), "bid")


@query(f"WITH {T_SQL}, b AS (SELECT bid, {BOX} FROM t GROUP BY bid) SELECT CASE WHEN bid % 3 = 0 THEN bid - bid % 9 ELSE bid END AS node_id, min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max FROM b GROUP BY 1")
def composite_left(spark, sf_dir):
    obs = observations(spark, sf_dir)
    members = obs.where("bid % 3 = 0").select("bid", (F.col("bid") - F.col("bid") % 9).alias("node_id")).distinct()
    return op.merge_bounds(op.bounds(obs), members)


@query(f"WITH {T_SQL}, a AS (SELECT bid, min(x) AS x_min, max(x) AS x_max FROM t WHERE x < 50 GROUP BY bid), b AS (SELECT bid, median(area) AS area_median FROM t WHERE x >= 20 GROUP BY bid) SELECT coalesce(a.bid, b.bid) AS bid, x_min, x_max, area_median FROM a FULL JOIN b ON a.bid = b.bid")
def moved_full(spark, sf_dir):
    obs = observations(spark, sf_dir)
    low = obs.where("x < 50").groupBy("bid").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    return low.join(op.sizes(obs.where("x >= 20")), "bid", "full")


@query(f"WITH {N_SQL} SELECT node_id FROM n WHERE node_id NOT IN (SELECT node_id FROM n WHERE x_max < 20)")
def anti_removed(spark, sf_dir):
    nodes = tracks(spark, sf_dir)
    return nodes.join(nodes.where("x_max < 20").select("node_id"), "node_id", "left_anti").select("node_id")


@query(f"""WITH {N_SQL} SELECT a.node_id AS node1, b.node_id AS node2, round(sqrt((b.x0 - a.xN) ** 2 + (b.y0 - a.yN) ** 2), 6) AS dist, b.t0 - a.tN AS dt
FROM n a JOIN n b ON a.node_id <> b.node_id AND b.t0 > a.tN AND b.t0 - a.tN < 3600 AND sqrt((b.x0 - a.xN) ** 2 + (b.y0 - a.yN) ** 2) < 10""")
def gap_candidates(spark, sf_dir):
    return gaps.close_pairs(tracks(spark, sf_dir), 3600, 10).select("node1", "node2", r6("dist").alias("dist"), "dt")


@query(f"""WITH {N_SQL} SELECT a.node_id AS node1, b.node_id AS node2, round(sqrt((b.x0 - a.xN) ** 2 + (b.y0 - a.yN) ** 2), 6) AS dist, b.t0 - a.tN AS dt FROM n a JOIN n b ON a.bid = b.bid AND b.t0 > a.tN""")
def gap_all_pairs(spark, sf_dir):
    """All later starts for each end, of the same object."""
    nodes = tracks(spark, sf_dir)
    ends, starts = nodes.select("bid", F.col("node_id").alias("node1"), "tN", "xN", "yN"), nodes.select("bid", F.col("node_id").alias("node2"), "t0", "x0", "y0")
    dist = F.hypot(F.col("x0") - F.col("xN"), F.col("y0") - F.col("yN"))
    return ends.join(starts, "bid").where("t0 > tN").select("node1", "node2", r6(dist).alias("dist"), (F.col("t0") - F.col("tN")).alias("dt"))


@query(f"""WITH {T_SQL}, p AS (SELECT bid AS other, frame AS other_frame, time AS seen FROM t WHERE kind = 'purchase'), r AS (SELECT bid * 1000000 + frame AS id, time FROM t WHERE kind = 'click')
SELECT id, round(distance, 6) AS distance, seen, other FROM (SELECT id, abs(seen - time) AS distance, seen, other, row_number() OVER (PARTITION BY id ORDER BY abs(seen - time), seen, other, other_frame) AS k FROM r, p) WHERE k = 1""")
def nearest_asof(spark, sf_dir):
    obs = observations(spark, sf_dir)
    left = obs.where("kind = 'click'").select((F.col("bid") * 1_000_000 + F.col("frame")).alias("id"), "time")
    right = obs.where("kind = 'purchase'").select(F.col("time").alias("seen"), F.col("bid").alias("other"), F.col("frame").alias("other_frame"))
    found = op.nearest_in_time(left, right, "time", "seen", "id", ["other", "other_frame"], 3600)
    return found.select("id", r6("distance").alias("distance"), "seen", "other")


@query(f"""WITH {T_SQL}, a AS (SELECT avg(c) AS true_num FROM (SELECT CAST(floor(time / 86400) AS BIGINT) AS day, count(*) FILTER (x >= 20 AND kind <> 'error') AS c FROM t GROUP BY 1)) SELECT round(true_num, 6) AS true_num FROM a""")
def true_num(spark, sf_dir):
    days = observations(spark, sf_dir).groupBy(F.floor(F.col("time") / 86400).alias("day")).agg(F.count_if((F.col("x") >= 20) & (F.col("kind") != "error")).alias("c"))
    return days.agg(r6(F.avg("c")).alias("true_num"))


BUCKETS = [(0, 600), (600, 3600), (3600, 7200), (7200, 14400)]


@query(f"""WITH {N_SQL} SELECT count(*) AS nodes, round(avg(tN - t0), 6) AS duration_mean, median(tN - t0) AS duration_med, round(stddev_pop(tN - t0), 6) AS duration_std,
{", ".join(f"count(*) FILTER (tN - t0 >= {a} AND tN - t0 < {b}) AS from_{a}" for a, b in BUCKETS)}, count(*) FILTER (tN - t0 >= 14400) AS from_14400 FROM n""")
def report_card(spark, sf_dir):
    life = F.col("tN") - F.col("t0")
    counts = [F.count_if((life >= a) & (life < b)).alias(f"from_{a}") for a, b in BUCKETS]
    lives = tracks(spark, sf_dir).withColumn("life", life)
    median = exact_quantiles(lives, "life", [0.5]).select(F.col("value").alias("duration_med"))  # one row
    return lives.crossJoin(F.broadcast(median)).groupBy("duration_med").agg(F.count("*").alias("nodes"), r6(F.avg(life)).alias("duration_mean"), r6(F.stddev_pop(life)).alias("duration_std"), *counts, F.count_if(life >= 14400).alias("from_14400"))


REASON = "CASE WHEN tN >= 2500000 THEN 'timing' WHEN xN >= 60 THEN 'outside-roi' WHEN joins THEN 'join' WHEN splits THEN 'split' WHEN xN < 5 OR yN < 5 THEN 'on_edge' ELSE 'unknown' END AS reason"
REASONS = ["timing", "outside-roi", "join", "split", "on_edge", "unknown"]


def _ends(spark, sf_dir):
    ends = tracks(spark, sf_dir).withColumns({"joins": F.col("last_kind") == "purchase", "splits": F.col("last_kind") == "signup"})
    return op.loss_reasons(ends, 5, 60, 2_500_000)


@query(f"WITH {N_SQL}, r AS (SELECT *, last_kind = 'purchase' AS joins, last_kind = 'signup' AS splits FROM n) SELECT node_id, {REASON} FROM r")
def loss_reasons(spark, sf_dir):
    return _ends(spark, sf_dir).select("node_id", "reason")


@query(f"""WITH {N_SQL}, r AS (SELECT *, last_kind = 'purchase' AS joins, last_kind = 'signup' AS splits FROM n), b AS (SELECT {REASON}, CASE WHEN tN - t0 < 60 THEN '<1' WHEN tN - t0 < 3600 THEN '<60' ELSE 'more' END AS life FROM r)
SELECT coalesce(life, 'total') AS life, {", ".join(f"count(*) FILTER (reason = '{x}') AS \"{x}\"" for x in REASONS)} FROM b GROUP BY ROLLUP (life)""")
def loss_pivot(spark, sf_dir):
    life = F.col("tN") - F.col("t0")
    rows = _ends(spark, sf_dir).select("reason", F.when(life < 60, "<1").when(life < 3600, "<60").otherwise("more").alias("life"))
    return rows.rollup("life").agg(*[F.count_if(F.col("reason") == x).alias(x) for x in REASONS]).withColumn("life", F.coalesce("life", F.lit("total")))


@query(f"WITH {N_SQL} SELECT least(CAST(floor((tN - t0) / 600) AS BIGINT), 10) AS bucket, round(sum(tN - t0) / 60, 6) AS minutes FROM n GROUP BY 1")
def worm_minutes(spark, sf_dir):
    life = F.col("tN") - F.col("t0")
    return tracks(spark, sf_dir).groupBy(F.least(F.floor(life / 600), F.lit(10).cast("long")).alias("bucket")).agg(r6(F.sum(life) / 60).alias("minutes"))


TENTHS = [k / 10 for k in range(1, 10)]


@query("SELECT l_suppkey, " + ", ".join(f"round(quantile_cont(l_quantity, {q}), 6) AS p{int(q * 100)}" for q in TENTHS) + " FROM lineitem GROUP BY l_suppkey")
def percentiles_wide(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", TENTHS).alias("p"))
    return p.select("l_suppkey", *[r6(F.col("p")[i]).alias(f"p{int(q * 100)}") for i, q in enumerate(TENTHS)])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1, 2""")
def dset_summary(spark, sf_dir):
    price, r4 = F.col("l_extendedprice"), lambda c: F.round(c, 4)
    q = lambda v: F.percentile(price, v)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r4(F.avg(price)).alias("mean"), r4(F.stddev_samp(price)).alias("std"), r4(q(0.25)).alias("q1"), r4(F.median(price)).alias("med"), r4(q(0.75)).alias("q3"))


@query("""SELECT coalesce(l_shipmode, 'all') AS label, bin, n, round(n / sum(n) OVER (PARTITION BY l_shipmode IS NULL, l_shipmode), 8) AS share FROM (
  SELECT l_returnflag AS l_shipmode, CAST(floor(l_discount * 100) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, bin), (bin)))""")
def histogram_norm(spark, sf_dir):
    """Shares of value bins for each label and for all."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.floor(F.col("l_discount") * 100).alias("bin"))
    counts = rows.groupingSets([["label", "bin"], ["bin"]], "label", "bin").agg(F.count("*").alias("n")).withColumn("label", F.coalesce("label", F.lit("all")))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 8))


JUDGED = "SELECT doc_id, doc_id // 50 AS frame, quality = 1 AS good, toxic = 0 AS roi FROM labels JOIN documents USING (doc_id)"


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.floor(F.col("doc_id") / 50).alias("frame"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("roi"))


@query(f"WITH j AS ({JUDGED}) SELECT frame, count(*) FILTER (good AND roi) AS true_pos, count(*) FILTER (NOT good AND roi) AS false_pos, count(*) FILTER (good AND NOT roi) AS false_neg FROM j GROUP BY frame")
def accuracy_by_frame(spark, sf_dir):
    good, roi = F.col("good"), F.col("roi")
    return _judged(spark, sf_dir).groupBy("frame").agg(F.count_if(good & roi).alias("true_pos"), F.count_if(~good & roi).alias("false_pos"), F.count_if(good & ~roi).alias("false_neg"))


@query(f"WITH j AS ({JUDGED}), k AS (SELECT frame, bool_or(good) AS has_good, bool_or(NOT good) AS has_bad FROM j GROUP BY frame) SELECT has_good, has_bad, count(*) AS n FROM k GROUP BY 1, 2")
def legitimacy_crosstab(spark, sf_dir):
    flags = _judged(spark, sf_dir).groupBy("frame").agg(F.bool_or("good").alias("has_good"), F.bool_or(~F.col("good")).alias("has_bad"))
    return flags.groupBy("has_good", "has_bad").agg(F.count("*").alias("n"))


@query(f"WITH j AS ({JUDGED}) SELECT frame, min(CAST(good AS INT)) AS answer FROM j GROUP BY frame HAVING min(CAST(good AS INT)) = max(CAST(good AS INT))")
def unanimous_answers(spark, sf_dir):
    good = F.col("good").cast("int")
    return _judged(spark, sf_dir).groupBy("frame").agg(F.min(good).alias("answer"), F.max(good).alias("other")).where("answer = other").drop("other")


@query(f"WITH {N_SQL} SELECT node_id, tN - t0 AS life FROM n ORDER BY life DESC, node_id LIMIT 5")
def longest_tracks(spark, sf_dir):
    return tracks(spark, sf_dir).select("node_id", (F.col("tN") - F.col("t0")).alias("life")).orderBy(F.desc("life"), "node_id").limit(5)


@query(f"WITH {N_SQL} SELECT bid, node_id, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY bid) AS cdf, 1 - (row_number() OVER w - 1) / count(*) OVER (PARTITION BY bid) AS ccdf FROM n WINDOW w AS (PARTITION BY bid ORDER BY tN - t0, node_id)")
def ecdf(spark, sf_dir):
    """Distribution functions of track lives within each object."""
    rank = F.row_number().over(Window.partitionBy("bid").orderBy(F.col("tN") - F.col("t0"), "node_id")) - 1
    cdf = rank / F.count("*").over(Window.partitionBy("bid"))
    return tracks(spark, sf_dir).select("bid", "node_id", cdf.alias("cdf"), (1 - cdf).alias("ccdf"))


@query(f"WITH {T_SQL} SELECT bid, frame, x FROM t WHERE frame = 3")
def nth_row(spark, sf_dir):
    return observations(spark, sf_dir).where("frame = 3").select("bid", "frame", "x")


SETS = "a AS (SELECT DISTINCT bid FROM t WHERE x < 5), b AS (SELECT DISTINCT bid FROM t WHERE y >= 95)"


def _id_sets(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.where("x < 5").select("bid"), obs.where("y >= 95").select("bid")


@query(f"WITH {T_SQL}, {SETS} SELECT bid FROM a INTERSECT SELECT bid FROM b")
def ids_intersect(spark, sf_dir):
    a, b = _id_sets(spark, sf_dir)
    return a.intersect(b)


@query(f"WITH {T_SQL}, {SETS} SELECT bid FROM a UNION SELECT bid FROM b")
def ids_union(spark, sf_dir):
    a, b = _id_sets(spark, sf_dir)
    return a.union(b).distinct()


@query(f"WITH {T_SQL}, {SETS} SELECT bid FROM a EXCEPT SELECT bid FROM b")
def ids_except(spark, sf_dir):
    a, b = _id_sets(spark, sf_dir)
    return a.subtract(b)


@query(f"WITH {T_SQL}, {SETS} (SELECT bid FROM a EXCEPT SELECT bid FROM b) UNION ALL (SELECT bid FROM b EXCEPT SELECT bid FROM a)")
def ids_symdiff(spark, sf_dir):
    a, b = _id_sets(spark, sf_dir)
    return a.subtract(b).union(b.subtract(a))
