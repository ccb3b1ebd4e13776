"""Queries of outlines, spines, curves and masks that cross."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import curves, models, spines, unzip
from trackloom.operators.batches import in_tasks
from trackloom.plans.registry import query
from trackloom.plans.stat_queries import OUTLINE_SQL
from trackloom.sources.shapes import P_SQL, crossing_poses, crossings, poses
from trackloom.sources.tracks import T_SQL, observations, table

r6 = lambda c: F.round(c, 6) + 0.0


@query(f"""WITH {P_SQL}, b AS (SELECT bid, frame, min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1 FROM s_ GROUP BY bid, frame),
g AS (SELECT bid, frame, i AS x, j AS y FROM b, unnest(range(x0, x1 + 1)) AS a(i), unnest(range(y0, y1 + 1)) AS c(j)),
d AS (SELECT g.bid, g.frame, g.x, g.y, min(greatest(abs(g.x - s_.x), abs(g.y - s_.y))) AS distance FROM g JOIN s_ USING (bid, frame) GROUP BY ALL)
SELECT bid, frame, distance, count(*) AS cells, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM d GROUP BY ALL""")
def mask_distances(spark, sf_dir):
    """Of the cells round each pose's spine: how many are how far from it, and the sums of their places."""
    pixels = spines.spine_rows(poses(spark, sf_dir), "spine", "bid", "frame")
    found = unzip.distances(pixels, "bid", "frame", margin=2)
    return found.groupBy("bid", "frame", "distance").agg(F.count("*").alias("cells"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


#: Events of a task; masks are some hundred times as large.
EVENTS = 20_000


def _unzipped(spark, sf_dir):
    """Events are laid into tasks by object, so that the masks stay in the task that draws them."""
    masks = crossings(spark, sf_dir, lambda events: in_tasks(events, events.count(), EVENTS, "bid"))
    return unzip.unzipped(masks, laid=True)


@query()
def unzipped(spark, sf_dir):
    """A crossing of two bars for each pose: which child is whose?"""
    truth = crossing_poses(spark, sf_dir).where("k IS NOT NULL").select("collision", "truth")
    return _unzipped(spark, sf_dir).join(truth, "collision")


@query()
def unzipped_pairs(spark, sf_dir):
    """Parent and child of the crossings that were resolved; bodies are numbered by collision."""
    found = _unzipped(spark, sf_dir)
    ids = lambda first: F.array(4 * F.col("collision") + first, 4 * F.col("collision") + first + 1)
    return unzip.untangling(found, ids(0), ids(2))


@query(f"""WITH {OUTLINE_SQL}, z AS (SELECT doc_id, x, y FROM xy UNION ALL SELECT doc_id, 0, 0 FROM c WHERE code <> '') SELECT doc_id, count(*) AS points, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys, CAST(sum(x * x + y * y) AS BIGINT) AS squares FROM z GROUP BY doc_id""")
def outline_points(spark, sf_dir):
    """All points of the texts read as outline codes, by their sums."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^0-o]", "").alias("code")).where("code != ''")
    rows = docs.select("doc_id", F.lit(0).alias("x"), F.lit(0).alias("y"), (3 * F.length("code")).alias("n"), "code")
    found = curves.outline_points(rows, "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("points"), F.sum("x").alias("xs"), F.sum("y").alias("ys"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("squares"))


@query(f"""WITH {P_SQL}, b AS (SELECT bid, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM o_ GROUP BY bid)
SELECT bid, frame, place, CAST(x - x0 + 1 AS INT) AS x, CAST(y - y0 + 1 AS INT) AS y, CAST(x1 - x0 + 3 AS INT) AS width, CAST(y1 - y0 + 3 AS INT) AS height FROM o_ JOIN b USING (bid)""")
def aligned_outlines(spark, sf_dir):
    """All outlines of an object in one grid."""
    out = unzip.aligned_outlines(unzip.outlines_of(poses(spark, sf_dir), "outline", "bid"), "outline", "bid")
    return out.select("bid", "frame", F.posexplode("shifted").alias("place", "p"), "width", "height").select("bid", "frame", F.col("place").cast("long").alias("place"), "p.x", "p.y", "width", "height")


@query(f"""WITH {P_SQL}, e AS (SELECT bid, min(frame) AS f0, max(frame) AS f1 FROM p GROUP BY bid), w AS (SELECT bid, f0 AS frame, 'first' AS which FROM e UNION ALL SELECT bid, f1, 'last' FROM e)
SELECT bid, which, frame, count(*) AS points, CAST(min(x) AS INT) AS x0, CAST(max(y) AS INT) AS y1 FROM w JOIN o_ USING (bid, frame) GROUP BY ALL""")
def end_outlines(spark, sf_dir):
    """The first and the last outline of each object."""
    rows = poses(spark, sf_dir)
    both = [unzip.outlines_of(rows, "outline", "bid", first=first).select("bid", F.lit(name).alias("which"), "frame", "outline") for first, name in ((True, "first"), (False, "last"))]
    out = both[0].union(both[1])
    return out.select("bid", "which", "frame", F.size("outline").cast("long").alias("points"), F.array_min("outline.x").alias("x0"), F.array_max("outline.y").alias("y1"))


@query()
def outline_spines(spark, sf_dir):
    """The centre line of each pose's mask."""
    rows = poses(spark, sf_dir).select("bid", "frame", spines.spine_from_outline(F.col("outline")).alias("spine"))
    ends = [F.get("spine", F.lit(0)).alias("begin"), F.element_at("spine", -1).alias("end")]
    return rows.select("bid", "frame", F.size("spine").alias("points"), *ends).select("bid", "frame", "points", F.col("begin.x").alias("x0"), F.col("begin.y").alias("y0"), F.col("end.x").alias("x1"), F.col("end.y").alias("y1"))


@query()
def treated_spines(spark, sf_dir):
    """Centre lines of outlines, smoothed, with 50 equally distant points, facing one way along an object's poses."""
    rows = poses(spark, sf_dir).withColumn("spine", spines.spine_from_outline(F.col("outline")))
    return spines.treated_spines(rows, "spine").select("bid", "frame", "place", r6("x").alias("x"), r6("y").alias("y"))


WIDTH_SQL = f"""WITH {P_SQL}, parts AS (SELECT * FROM (VALUES ('width20', 0.2), ('width50', 0.5), ('width80', 0.8)) AS v(name, part)),
l AS (SELECT a.bid, a.frame, name, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS u, -(b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS v
  FROM parts JOIN s_ a ON a.place = least(CAST(floor(a.n * part) AS INT), a.n - 2) JOIN s_ b ON b.bid = a.bid AND b.frame = a.frame AND b.place = a.place + 1),
e AS (SELECT bid, frame, x AS ax, y AS ay, lead(x, 1, first_x) OVER w AS bx, lead(y, 1, first_y) OVER w AS by_ FROM (SELECT *, first_value(x) OVER q AS first_x, first_value(y) OVER q AS first_y FROM o_ WINDOW q AS (PARTITION BY bid, frame ORDER BY place)) WINDOW w AS (PARTITION BY bid, frame ORDER BY place)),
c AS (SELECT l.*, ax, ay, bx, by_, ((bx - ax) * (my - ay) - (by_ - ay) * (mx - ax)) / nullif((by_ - ay) * u - (bx - ax) * v, 0) AS far FROM l JOIN e USING (bid, frame)),
m AS (SELECT DISTINCT bid, frame, name, far FROM c WHERE mx + far * u + 0.5 >= least(ax, bx) AND mx + far * u - 0.5 <= greatest(ax, bx) AND my + far * v + 0.5 >= least(ay, by_) AND my + far * v - 0.5 <= greatest(ay, by_))
SELECT bid, frame, name, round(min(far) FILTER (far >= 0) - max(far) FILTER (far < 0), 6) + 0.0 AS width FROM m GROUP BY ALL"""


@query(WIDTH_SQL)
def spine_widths(spark, sf_dir):
    """Widths of each pose at 20, 50 and 80 per cent of its spine."""
    out = spines.widths(poses(spark, sf_dir), "spine", "outline")
    names = ["width20", "width50", "width80"]
    return out.select("bid", "frame", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("width")) for n in names])).alias("w")).select("bid", "frame", "w.name", r6("w.width").alias("width"))


@query(f"""WITH {P_SQL}, d AS (SELECT a.bid, b.frame, a.place, a.n, b.n AS n2, b.time - a.time AS dt, a.x - b.x AS mx, a.y - b.y AS my, lead(a.x) OVER w - a.x AS sx, lead(a.y) OVER w - a.y AS sy FROM s_ a LEFT JOIN s_ b ON b.bid = a.bid AND b.frame = a.frame + 1 AND b.place = a.place WINDOW w AS (PARTITION BY a.bid, a.frame ORDER BY a.place))
SELECT bid, frame, round(sum((mx * sx + my * sy) / sqrt(sx * sx + sy * sy)) / max(n) / max(dt), 9) + 0.0 AS along, round(sum(abs((mx * sy - my * sx) / sqrt(sx * sx + sy * sy))) / max(n) / max(dt), 9) + 0.0 AS across
FROM d WHERE sx IS NOT NULL AND frame IS NOT NULL GROUP BY bid, frame""")
def spine_speeds(spark, sf_dir):
    """Speed along and across the spine from each pose to the object's next."""
    w = Window.partitionBy("bid").orderBy("frame")
    rows = poses(spark, sf_dir).select("bid", F.lead("frame").over(w).alias("frame"), "spine", F.lead("spine").over(w).alias("next"), (F.lead("time").over(w) - F.col("time")).alias("dt")).where("next is not null")
    speed = lambda across: F.round(spines.speed_along(F.col("spine"), F.col("next"), F.col("dt"), across), 9) + 0.0
    return rows.select("bid", "frame", speed(False).alias("along"), speed(True).alias("across"))


@query(f"""WITH {P_SQL}, r AS (SELECT *, sum(d) OVER (PARTITION BY bid, frame ORDER BY place) AS run, sum(d) OVER (PARTITION BY bid, frame) AS total FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM s_ WINDOW w AS (PARTITION BY bid, frame ORDER BY place))),
k AS (SELECT bid, frame, i AS place, i * total / 20 AS target FROM (SELECT bid, frame, max(total) AS total FROM r GROUP BY bid, frame), unnest(range(21)) AS q(i)),
g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(run) OVER w AS run2 FROM r WINDOW w AS (PARTITION BY bid, frame ORDER BY place)),
a AS (SELECT k.bid, k.frame, k.place, k.target, g.x, g.y, g.run, g.x2, g.y2, g.run2 FROM k ASOF JOIN g ON k.bid = g.bid AND k.frame = g.frame AND k.target >= g.run)
SELECT bid, frame, place, round(CASE WHEN x2 IS NULL THEN x ELSE x + (target - run) / (run2 - run) * (x2 - x) END, 6) + 0.0 AS x, round(CASE WHEN y2 IS NULL THEN y ELSE y + (target - run) / (run2 - run) * (y2 - y) END, 6) + 0.0 AS y FROM a""")
def spaced_spines(spark, sf_dir):
    """21 equally distant points of each pose's spine."""
    rows = spines.spine_rows(poses(spark, sf_dir), "spine", "bid", "frame")
    return curves.spaced(rows, 21, ("bid", "frame")).select("bid", "frame", "place", r6("x").alias("x"), r6("y").alias("y"))


AROUND = models.savgol_weights(7, 3)
around_sql = lambda c: " + ".join(f"({w!r}) * " + (c if k == 0 else f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER w") for k, w in zip(range(-3, 4), AROUND))


@query(f"""WITH {P_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY bid, frame) AS n FROM o_), d AS (SELECT bid, frame, n, place + t * n AS place, x, y FROM c, (VALUES (-1), (0), (1)) AS v(t) WHERE place + t * n BETWEEN -3 AND n + 2),
m AS (SELECT bid, frame, place, n, {around_sql("x")} AS x, {around_sql("y")} AS y FROM d WINDOW w AS (PARTITION BY bid, frame ORDER BY place))
SELECT bid, frame, place, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM m WHERE place >= 0 AND place < n""")
def smoothed_outlines(spark, sf_dir):
    """Closed outlines under a filter of seven points, which needs no more than the three of the other end."""
    rows = spines.spine_rows(poses(spark, sf_dir), "outline", "bid", "frame")
    n = rows.groupBy("bid", "frame").agg(F.count("*").alias("n"))
    out = curves.smoothed_around(rows, 7, 3, ("bid", "frame")).join(n, ["bid", "frame"]).where("place < n")
    return out.select("bid", "frame", F.col("place").cast("long").alias("place"), r6("x").alias("x"), r6("y").alias("y"))


@query(f"""WITH RECURSIVE {P_SQL}, e AS (SELECT bid, frame, CASE WHEN k % 3 = 0 THEN bx ELSE ax END AS ax, CASE WHEN k % 3 = 0 THEN by_ ELSE ay END AS ay, CASE WHEN k % 3 = 0 THEN ax ELSE bx END AS bx, CASE WHEN k % 3 = 0 THEN ay ELSE by_ END AS by_
  FROM (SELECT bid, frame, any_value(k) AS k, arg_min(x, place) AS ax, arg_min(y, place) AS ay, arg_max(x, place) AS bx, arg_max(y, place) AS by_ FROM s_ GROUP BY bid, frame)),
f AS (SELECT bid, frame, false AS turned, ax AS px, ay AS py FROM e WHERE frame = 0 UNION ALL
  SELECT e.bid, e.frame, t.turned, CASE WHEN t.turned THEN bx ELSE ax END, CASE WHEN t.turned THEN by_ ELSE ay END
  FROM f JOIN e ON e.bid = f.bid AND e.frame = f.frame + 1, LATERAL (SELECT (px - ax) ** 2 + (py - ay) ** 2 > (px - bx) ** 2 + (py - by_) ** 2 AS turned) t)
SELECT bid, frame, turned FROM f""")
def facing_spines(spark, sf_dir):
    """Is a pose's spine to be read backwards to face like the one before? A third of the spines are stored backwards first."""
    rows = poses(spark, sf_dir)
    back = F.size("spine") % 3 == 0  # the length is 24 + k % 9
    first, last = F.get("spine", F.lit(0)), F.element_at("spine", -1)
    return curves.kept_direction(rows, F.when(back, last).otherwise(first), F.when(back, first).otherwise(last)).select("bid", "frame", "turned")


@query(f"""WITH RECURSIVE {T_SQL}, g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY bid ORDER BY frame)),
i AS (SELECT bid, (frame - 1) * 10 + k AS pos, x + k / 10 * (x2 - x) AS x, y + k / 10 * (y2 - y) AS y FROM g, unnest(range(10)) AS r(k) WHERE x2 IS NOT NULL),
f AS (SELECT bid, 0 AS place, pos, x, y FROM i WHERE pos = 0 UNION ALL
  SELECT bid, place + 1, n.pos, n.x, n.y FROM (SELECT f.bid, f.place, min_by(struct_pack(pos := i.pos, x := i.x, y := i.y), i.pos) AS n FROM f JOIN i ON i.bid = f.bid AND i.pos > f.pos AND sqrt((i.x - f.x) ** 2 + (i.y - f.y) ** 2) >= 40 GROUP BY f.bid, f.place))
SELECT bid, CAST(place AS BIGINT) AS place, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM f""")
def stepped_paths(spark, sf_dir):
    """Points of each object's path at least 40 apart, ten to a segment looked at."""
    rows = observations(spark, sf_dir).withColumnRenamed("frame", "place")
    return curves.stepped(rows, 40.0, 10).select("bid", "place", r6("x").alias("x"), r6("y").alias("y"))
