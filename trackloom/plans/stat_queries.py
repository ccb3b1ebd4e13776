"""Geometry, parsing and statistics queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import curves, nearest, stats
from trackloom.plans.registry import query
from trackloom.sources import summary
from trackloom.sources.tracks import N_SQL, S_SQL, T_SQL, observations, table, tracks, with_segments

r6 = lambda c: F.round(c, 6) + 0.0
LAST = "WINDOW w AS (PARTITION BY bid ORDER BY frame)"

CODE = "regexp_replace(text, '[^0-o]', '', 'g')"
OUTLINE_SQL = f"""c AS (SELECT doc_id, {CODE} AS code FROM documents), b AS (SELECT doc_id, i, ascii(code[i]) - 48 AS v FROM c, unnest(range(1, length(code) + 1)) AS r(i)),
st AS (SELECT doc_id, 3 * i + k AS o, (v >> (4 - 2 * k)) & 3 AS s FROM b, (VALUES (0), (1), (2)) AS q(k)),
xy AS (SELECT doc_id, sum(CASE s WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END) OVER w AS x, sum(CASE s WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END) OVER w AS y, o FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY o))"""


@query(f"""WITH {OUTLINE_SQL} SELECT doc_id, CAST(count(*) AS INT) AS steps, CAST(arg_max(x, o) AS INT) AS x, CAST(arg_max(y, o) AS INT) AS y, CAST(least(min(x), 0) AS INT) AS x_min, CAST(greatest(max(x), 0) AS INT) AS x_max, CAST(least(min(y), 0) AS INT) AS y_min, CAST(greatest(max(y), 0) AS INT) AS y_max FROM xy GROUP BY doc_id""")
def outline_decode(spark, sf_dir):
    """Texts read as outline codes: where each outline ends and its bounds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^0-o]", "").alias("code")).where("code != ''")
    rows = docs.select("doc_id", F.lit(0).alias("x"), F.lit(0).alias("y"), (3 * F.length("code")).alias("n"), "code")
    return curves.outline_extents(rows, "doc_id")


PATH_SQL = "p AS (SELECT bid, segment, list(x ORDER BY frame) AS xs, list(y ORDER BY frame) AS ys, count(*) AS n FROM s GROUP BY bid, segment)"


def _paths(spark, sf_dir):
    """bid, segment, points: each track's positions in order; a track is short by its pauses."""
    rows = with_segments(observations(spark, sf_dir), 14400)
    pts = F.transform(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return rows.groupBy("bid", "segment").agg(pts.alias("points"))


@query(f"""WITH {S_SQL}, d AS (SELECT bid, segment, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS step FROM s WINDOW o AS (PARTITION BY bid, segment ORDER BY frame))
SELECT bid, CAST(segment AS BIGINT) AS segment, round(coalesce(sum(step), 0), 6) + 0.0 AS length FROM d GROUP BY bid, segment""")
def polyline_length(spark, sf_dir):
    return _paths(spark, sf_dir).select("bid", "segment", r6(geo.polyline_length(F.col("points"))).alias("length"))


@query(f"""WITH {S_SQL}, t3 AS (SELECT bid, segment, row_number() OVER o AS k, x, y, lag(x) OVER o AS px, lag(y) OVER o AS py, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM s WINDOW o AS (PARTITION BY bid, segment ORDER BY frame)),
sides AS (SELECT bid, segment, sqrt((px - x) ** 2 + (py - y) ** 2) AS a, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS b, sqrt((px - nx) ** 2 + (py - ny) ** 2) AS c FROM t3 WHERE k >= 3 AND nx IS NOT NULL),
h AS (SELECT *, (a + b + c) / 2 AS q FROM sides)
SELECT bid, CAST(segment AS BIGINT) AS segment, round(avg(CASE WHEN a * b * c = 0 THEN 0 ELSE 4 * sqrt(greatest(q * (q - a) * (q - b) * (q - c), 0)) / (a * b * c) END), 5) + 0.0 AS curvature FROM h GROUP BY bid, segment""")
def curvature_sss(spark, sf_dir):
    out = _paths(spark, sf_dir).select("bid", "segment", (F.round(geo.curvature(F.col("points")), 5) + 0.0).alias("curvature"))
    return out.where("curvature is not null")


@query(f"""WITH {N_SQL} SELECT a.node_id AS one, b.node_id AS two FROM n a JOIN n b ON a.bid = b.bid AND a.node_id < b.node_id AND a.x_min <= b.x_max AND b.x_min <= a.x_max AND a.y_min <= b.y_max AND b.y_min <= a.y_max""")
def box_overlap(spark, sf_dir):
    """Pairs of an object's tracks whose bounds meet."""
    box = tracks(spark, sf_dir).select("bid", "node_id", F.struct("x_min", "x_max", "y_min", "y_max").alias("box"))
    pairs = box.toDF("bid", "one", "a").join(box.toDF("bid", "two", "b"), "bid").where("one < two")
    return pairs.where(geo.boxes_overlap(F.col("a"), F.col("b"))).select("one", "two")


@query(f"WITH {T_SQL} SELECT bid, frame, round(cos(0.5) * x - sin(0.5) * y + 3, 6) + 0.0 AS x, round(sin(0.5) * x + cos(0.5) * y - 2, 6) + 0.0 AS y FROM t")
def affine_rotate(spark, sf_dir):
    x, y = geo.rotate(F.col("x"), F.col("y"), 0.5, (3.0, -2.0))
    return observations(spark, sf_dir).select("bid", "frame", r6(x).alias("x"), r6(y).alias("y"))


@query(f"""WITH {T_SQL}, p AS (SELECT bid, frame, x AS bx, y AS by_, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy FROM t {LAST}),
d AS (SELECT *, 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_)) AS d FROM p)
SELECT bid, frame, round(((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / d, 4) + 0.0 AS x,
  round(((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d, 4) + 0.0 AS y FROM d WHERE abs(d) > 1""")
def circle_3pt(spark, sf_dir):
    """Centre of the circle through each position and its neighbours, where they aren't nearly in line."""
    w = Window.partitionBy("bid").orderBy("frame")
    at = lambda k: F.struct(*[(F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w)).alias(c) for c in ("x", "y")])
    rows = observations(spark, sf_dir).select("bid", "frame", at(1).alias("a"), F.struct("x", "y").alias("b"), at(-1).alias("c"))
    twice = 2 * (F.col("a.x") * (F.col("b.y") - F.col("c.y")) + F.col("b.x") * (F.col("c.y") - F.col("a.y")) + F.col("c.x") * (F.col("a.y") - F.col("b.y")))
    rows = rows.where(F.abs(twice) > 1).withColumn("o", geo.circle_through(F.col("a"), F.col("b"), F.col("c")))
    return rows.select("bid", "frame", (F.round("o.x", 4) + 0.0).alias("x"), (F.round("o.y", 4) + 0.0).alias("y"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), p AS (
SELECT query, vec_id, list_dot_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS c FROM q, embeddings WHERE query <> vec_id)
SELECT query, vec_id, round(c, 6) + 0.0 AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS k FROM p) WHERE k <= 5""")
def cosine_top(spark, sf_dir):
    """The five nearest vectors of each vector whose id divides by 100; every task keeps five a query."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest.nearest_vectors(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5)
    return found.select("query", "vec_id", r6("cosine").alias("cosine"))


LINES = "lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)"


@query(f"WITH {LINES} SELECT conv_id, turn, count(*) AS n_lines, CAST(sum(len(list_filter(regexp_split_to_array(trim(line, ' '), '\\s+'), lambda w: w <> '')) // 2) AS BIGINT) AS n_pairs FROM lines GROUP BY 1, 2")
def summary_pairs(spark, sf_dir):
    """Lines of each turn read as pair lists."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    pairs = F.size(summary.pair_list(F.col("line")))
    return lines.groupBy("conv_id", "turn").agg(F.count("*").alias("n_lines"), F.sum(pairs).cast("long").alias("n_pairs"))


@query("""WITH h AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header, role FROM conversations)
SELECT conv_id, turn, header FROM h WHERE role <> 'user' AND header IS NOT NULL""")
def blob_header_ffill(spark, sf_dir):
    """Turns under the last user turn above them, as object lines stand under their header."""
    rows = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("% "), F.col("turn").cast("string"))).otherwise(F.lit("line"))
    out = summary.with_header(rows.select("conv_id", "turn", line.alias("value")), "conv_id", "turn")
    return out.select("conv_id", "turn", F.col("bid").alias("header"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.roi_type'), 'circle') AS roi_type FROM events")
def json_defaults(spark, sf_dir):
    """Settings from JSON, with defaults for what it lacks."""
    parsed = F.from_json("props", "k int, roi_type string")
    rows = table(spark, sf_dir, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce("p.roi_type", F.lit("circle")).alias("roi_type"))


@query(f"""WITH {T_SQL}, n AS (SELECT count(*) FILTER (kind = 'click') AS n1, count(*) FILTER (kind <> 'click') AS n2 FROM t), c AS (
SELECT DISTINCT sum(CAST(kind = 'click' AS INT)) OVER (ORDER BY x) AS a, sum(CAST(kind <> 'click' AS INT)) OVER (ORDER BY x) AS b FROM t)
SELECT n1, n2, round(max(abs(a / n1 - b / n2)), 8) AS ks FROM c, n GROUP BY n1, n2""")
def ks_two_sample(spark, sf_dir):
    out = stats.ks_two_sample(observations(spark, sf_dir), "x", F.col("kind") == "click", 5)
    return out.select("n1", "n2", F.round("ks", 8).alias("ks"))


@query(f"""WITH {T_SQL}, k AS (SELECT DISTINCT kind FROM t), v AS (SELECT DISTINCT x FROM t), c AS (SELECT kind, x, count(*) AS c FROM t GROUP BY 1, 2),
g AS (SELECT k.kind, v.x, coalesce(c, 0) AS c FROM k CROSS JOIN v LEFT JOIN c ON c.kind = k.kind AND c.x = v.x), f AS (SELECT kind, x, sum(c) OVER (PARTITION BY kind ORDER BY x) / sum(c) OVER (PARTITION BY kind) AS p FROM g)
SELECT a.kind AS one, b.kind AS two, round(max(abs(a.p - b.p)), 8) AS ks FROM f a JOIN f b ON a.x = b.x AND a.kind < b.kind GROUP BY 1, 2""")
def ks_all_pairs(spark, sf_dir):
    return stats.ks_all_pairs(observations(spark, sf_dir), "x", "kind", 5).select("one", "two", F.round("ks", 8).alias("ks"))


@query(f"WITH {T_SQL}, c AS (SELECT bid, kind, count(*) AS c FROM t GROUP BY 1, 2), p AS (SELECT bid, c / sum(c) OVER (PARTITION BY bid) AS p FROM c) SELECT bid, round(log2(count(*)) + sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY bid")
def excess_entropy(spark, sf_dir):
    return stats.excess_entropy(observations(spark, sf_dir), "bid", "kind").select("bid", r6("entropy").alias("entropy"))


@query(f"""WITH {T_SQL}, d AS (SELECT bid, frame, lag(x) OVER w - lag(x, 2) OVER w AS ax, lag(y) OVER w - lag(y, 2) OVER w AS ay, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS by_ FROM t {LAST})
SELECT bid, frame, ax * bx + ay * by_ < 0 AS reversal, round(sqrt(bx * bx + by_ * by_), 6) AS speed, round(sqrt(bx * bx + by_ * by_) - sqrt(ax * ax + ay * ay), 6) + 0.0 AS acceleration, round(atan2(ax * by_ - ay * bx + 0.0, ax * bx + ay * by_), 6) + 0.0 AS turn FROM d""")
def markov_measures(spark, sf_dir):
    out = stats.markov_measures(observations(spark, sf_dir))
    return out.select("bid", "frame", "reversal", *[r6(c).alias(c) for c in ("speed", "acceleration", "turn")])


@query(f"WITH {T_SQL} SELECT bid, round(regr_slope(x, time / 1e5), 5) + 0.0 AS slope, round(regr_intercept(x, time / 1e5), 5) + 0.0 AS intercept, round(regr_r2(x, time / 1e5), 6) + 0.0 AS r2, CAST(regr_count(x, time / 1e5) AS BIGINT) AS n FROM t GROUP BY bid")
def regr_lines(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("day", F.col("time") / 1e5)
    out = stats.regression_lines(rows, "bid", "x", "day")
    return out.select("bid", (F.round("slope", 5) + 0.0).alias("slope"), (F.round("intercept", 5) + 0.0).alias("intercept"), r6("r2").alias("r2"), "n")


@query(f"""WITH {T_SQL}, d AS (SELECT bid, frame, (lead(frame) OVER w - lag(frame) OVER w) / 2 AS dx, lead(x) OVER w AS nx, lag(x) OVER w AS px, x FROM t {LAST}), k AS (SELECT bid, frame, (nx - px) / (2 * dx) AS slope, (nx - 2 * x + px) / (dx * dx) AS d2 FROM d)
SELECT bid, frame, round(slope, 6) + 0.0 AS slope, round(d2 / pow(1 + slope * slope, 1.5), 6) + 0.0 AS bend FROM k""")
def derivative(spark, sf_dir):
    out = stats.derivative(observations(spark, sf_dir), "x", "frame", "bid", "frame")
    return out.select("bid", "frame", r6("slope").alias("slope"), r6("bend").alias("bend"))


@query(f"WITH {T_SQL}, p AS (SELECT bid, frame, coalesce((frame - lag(frame) OVER w) * (x + lag(x) OVER w) / 2, 0) AS part FROM t {LAST}) SELECT bid, frame, round(sum(part) OVER w, 5) + 0.0 AS area FROM p {LAST}")
def integral(spark, sf_dir):
    out = stats.integral(observations(spark, sf_dir), "x", "frame", "bid", "frame")
    return out.select("bid", "frame", (F.round("area", 5) + 0.0).alias("area"))


@query(f"WITH {T_SQL}, m AS (SELECT bid, avg(x) AS m, stddev_samp(x) AS s FROM t GROUP BY bid) SELECT bid, frame, round((x - m) / s, 6) + 0.0 AS x FROM t JOIN m USING (bid)")
def standardised(spark, sf_dir):
    return stats.standardise(observations(spark, sf_dir), ["x"], ["bid"]).select("bid", "frame", r6("x").alias("x"))


@query(f"WITH {T_SQL}, f AS (SELECT x > 30 AS found, area > 30 AS truth FROM t), c AS (SELECT count(*) FILTER (found AND truth) AS tp, count(*) FILTER (found AND NOT truth) AS fp, count(*) FILTER (NOT found AND NOT truth) AS tn, count(*) FILTER (NOT found AND truth) AS fn FROM f) SELECT tp, fp, tn, fn, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tp / (tp + fp) AS precision, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def roc_counts(spark, sf_dir):
    return observations(spark, sf_dir).agg(*stats.confusion(F.col("x") > 30, F.col("area") > 30))


BREAKS = "b AS (SELECT bid, floor(time / 50000) * 50000 AS start, floor(time / 50000) * 50000 + 20000 + (bid % 7) * 4000 AS \"end\" FROM t GROUP BY 1, 2, 3), u AS (SELECT DISTINCT bid, floor(time / 90000) * 90000 + 5000 AS start, floor(time / 90000) * 90000 + 40000 AS \"end\" FROM t)"


@query(f"""WITH {T_SQL}, {BREAKS}, o AS (SELECT u.bid, u.start, u."end", count(b.bid) AS hits, coalesce(sum(CASE WHEN b.bid IS NOT NULL THEN least(u."end", b."end") - greatest(u.start, b.start) END), 0) AS covered FROM u LEFT JOIN b ON b.bid = u.bid AND b.start <= u."end" AND u.start <= b."end" GROUP BY 1, 2, 3)
SELECT bid, start AS t_start, "end" AS t_end, hits, round(covered / ("end" - start), 6) AS share FROM o""")
def interval_coverage(spark, sf_dir):
    obs, t = observations(spark, sf_dir), F.col("time")
    found = obs.select("bid", (F.floor(t / 50000) * 50000.0).alias("start")).distinct().withColumn("end", F.col("start") + 20000 + F.col("bid") % 7 * 4000)
    truth = obs.select("bid", (F.floor(t / 90000) * 90000.0 + 5000).alias("start")).distinct().withColumn("end", F.col("start") + 35000)
    return stats.interval_overlaps(found, truth, "bid", 50000).withColumn("share", F.round("share", 6))


@query()
def pca_scores(spark, sf_dir):
    _, scored = stats.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    return scored.select("vec_id", F.transform("scores", lambda s: F.round(s, 6)).alias("scores"))


@query()
def top_loadings(spark, sf_dir):
    """The five dimensions with the largest squared loading of each of four components."""
    model, _ = stats.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    loadings = model.pc.toArray()
    rows = [(c + 1, d, float(round(loadings[d, c] ** 2, 8))) for c in range(loadings.shape[1]) for d in range(loadings.shape[0])]
    best = Window.partitionBy("component").orderBy(F.desc("squared"), "dimension")
    return spark.createDataFrame(rows, "component int, dimension int, squared double").withColumn("place", F.row_number().over(best)).where("place <= 5")
