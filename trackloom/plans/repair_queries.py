"""Queries of the matching, stop and repair operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import graph as g
from trackloom.operators import matching, stops
from trackloom.plans.graph_queries import D_SQL, E_SQL, WITHIN, changed_around, crossings, diamond_graph
from trackloom.plans.lineage import cut
from trackloom.plans.registry import query
from trackloom.sources import sinks
from trackloom.sources.tracks import S_SQL, T_SQL, observations, table, track_degrees, track_edges, tracks, with_segments

r6 = lambda c: F.round(c, 6) + 0.0

BOXES = "b AS (SELECT bid * 1000000 + frame AS id, CAST(floor(time / 21600) AS BIGINT) AS frame, x, y, x - 5 AS x_min, x + 5 AS x_max, y - 5 AS y_min, y + 5 AS y_max FROM t)"


@query(f"""WITH {T_SQL}, {BOXES}, f AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nxt FROM (SELECT DISTINCT frame FROM b)),
p AS (SELECT a.id, c.id AS next_id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - c.x) ** 2 + (a.y - c.y) ** 2, c.id) AS k FROM b a JOIN f USING (frame) JOIN b c ON c.frame = f.nxt AND a.x_min <= c.x_max AND c.x_min <= a.x_max AND a.y_min <= c.y_max AND c.y_min <= a.y_max)
SELECT id, next_id FROM p WHERE k = 1""")
def bbox_next_frame(spark, sf_dir):
    """Observations as boxes, in frames of six hours."""
    x, y = F.col("x"), F.col("y")
    boxes = observations(spark, sf_dir).select((F.col("bid") * 1_000_000 + F.col("frame")).alias("id"), F.floor(F.col("time") / 21600).alias("frame"), "x", "y", (x - 5).alias("x_min"), (x + 5).alias("x_max"), (y - 5).alias("y_min"), (y + 5).alias("y_max"))
    return matching.next_frame_matches(boxes)


@query(f"""WITH {T_SQL}, {BOXES}, p AS (SELECT a.frame, a.id, c.id AS other, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) AS d FROM b a JOIN b c ON a.frame = c.frame AND a.id <> c.id AND a.id % 2 = 0 AND c.id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY frame, id ORDER BY d, other) AS k FROM p WHERE d <= 10)
SELECT frame, id, other, round(d, 6) + 0.0 AS distance FROM k WHERE k = 1""")
def nearest_object(spark, sf_dir):
    rows = observations(spark, sf_dir).select((F.col("bid") * 1_000_000 + F.col("frame")).alias("id"), F.floor(F.col("time") / 21600).alias("frame"), "x", "y")
    return matching.nearest_object(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 10).withColumn("distance", r6("distance"))


@query(f"""WITH {T_SQL}, f AS (SELECT bid, time FROM t WHERE kind = 'error') SELECT bid, frame FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.bid = t.bid AND abs(f.time - t.time) < 3600)""")
def band_antijoin(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return matching.without_flagged(obs, obs.where("kind = 'error'").select("bid", "time"), "bid", "time", 3600).select("bid", "frame")


CONDENSED = f"""{D_SQL}, m AS (SELECT node_id AS bid, CASE WHEN (node_id // 4) % 2 = 0 THEN node_id - node_id % 4 ELSE node_id END AS node_id FROM v)"""


def _condensed(spark, sf_dir):
    graph = diamond_graph(spark, sf_dir)
    mapping = graph[0].where("floor(node_id / 4) % 2 = 0").select(F.col("node_id").alias("old"), (F.col("node_id") - F.col("node_id") % 4).alias("new"))
    return graph, g.condense(graph, mapping)


@query(f"WITH {CONDENSED} SELECT bid, node_id FROM m")
def component_contains(spark, sf_dir):
    before, after = _condensed(spark, sf_dir)
    return matching.containing(after[0], before[0].select(F.col("node_id").alias("bid")))


@query(f"WITH {CONDENSED} SELECT src AS a, dst AS b, x.node_id = y.node_id AS joined FROM e JOIN m x ON x.bid = src JOIN m y ON y.bid = dst")
def gap_status(spark, sf_dir):
    before, after = _condensed(spark, sf_dir)
    return matching.same_node(before[1].select(F.col("src").alias("a"), F.col("dst").alias("b")), after[0])


@query(f"""WITH {CONDENSED}, a AS (SELECT src, dst FROM e), b AS (SELECT DISTINCT x.node_id AS src, y.node_id AS dst FROM e JOIN m x ON x.bid = src JOIN m y ON y.bid = dst WHERE x.node_id <> y.node_id)
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def edges_symdiff(spark, sf_dir):
    """Edges that one of two graphs has and the other hasn't: none at a fixpoint."""
    before, after = (x[1].select("src", "dst") for x in _condensed(spark, sf_dir))
    return before.subtract(after).union(after.subtract(before))


@query(f"""WITH {T_SQL}, p AS (SELECT bid, frame, x, y, lead(frame) OVER w AS f2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WHERE kind <> 'click' WINDOW w AS (PARTITION BY bid ORDER BY frame)),
q AS (SELECT *, unnest(range(frame, f2)) AS at_ FROM p WHERE f2 IS NOT NULL)
SELECT bid, at_ AS frame, round(x + (at_ - frame) / (f2 - frame) * (x2 - x), 6) + 0.0 AS x, round(y + (at_ - frame) / (f2 - frame) * (y2 - y), 6) + 0.0 AS y FROM q""")
def fill_gaps(spark, sf_dir):
    out = stops.fill_frames(observations(spark, sf_dir).where("kind != 'click'").select("bid", "frame", "x", "y"), ["x", "y"])
    return out.select("bid", "frame", r6("x").alias("x"), r6("y").alias("y"))


@query(f"""WITH {T_SQL}, p AS (SELECT a.bid, a.frame, max(CASE WHEN sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 60 THEN b.frame END) AS far, min(b.frame) AS low FROM t a JOIN t b ON a.bid = b.bid AND b.frame < a.frame AND b.frame >= a.frame - 20 GROUP BY 1, 2),
s AS (SELECT bid, frame, CASE WHEN frame <= 3 THEN 0 ELSE frame - coalesce(far + 1, low) END AS score FROM p),
i AS (SELECT bid, frame - score AS start, frame AS stop FROM s WHERE score > 5),
k AS (SELECT *, CAST(coalesce(start > max(stop) OVER (PARTITION BY bid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS INT) AS new FROM i),
u AS (SELECT *, sum(new) OVER (PARTITION BY bid ORDER BY start, stop) AS island FROM k)
SELECT bid, min(start) AS start, max(stop) AS "end" FROM u GROUP BY bid, island""")
def stop_intervals(spark, sf_dir):
    return stops.stop_intervals(observations(spark, sf_dir), 60, 5, 20)


@query(f"""WITH {T_SQL}, g AS (SELECT bid, frame, x > 20 AS hit FROM t), i AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY frame) - row_number() OVER (PARTITION BY bid, hit ORDER BY frame) AS island FROM g)
SELECT bid, frame, hit AND count(*) OVER (PARTITION BY bid, hit, island) >= 5 AS moving FROM i""")
def behaviour_runs(spark, sf_dir):
    return stops.behaviour(observations(spark, sf_dir), "x", 20, 5, "moving").select("bid", "frame", "moving")


@query(f"WITH {T_SQL} SELECT CAST(floor(time / 3600) AS BIGINT) AS second, round(avg(x), 6) + 0.0 AS mean, round(quantile_cont(x, 0.25), 6) + 0.0 AS q1, round(quantile_cont(x, 0.5), 6) + 0.0 AS q2, round(quantile_cont(x, 0.75), 6) + 0.0 AS q3, count(x) AS n FROM t GROUP BY 1")
def per_second(spark, sf_dir):
    out = stops.per_second(observations(spark, sf_dir), "x", step=3600)
    return out.select("second", *[r6(c).alias(c) for c in ("mean", "q1", "q2", "q3")], "n")


@query(f"WITH {T_SQL}, p AS (SELECT bid, floor(time / 3600) AS h, count(*) AS c FROM t GROUP BY 1, 2) SELECT bid, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS duplicates, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS share FROM p GROUP BY bid")
def duplicate_frames(spark, sf_dir):
    return stops.duplicate_frames(observations(spark, sf_dir).withColumn("frame", F.floor(F.col("time") / 3600)))


@query(f"WITH {S_SQL} SELECT bid, CAST(segment AS BIGINT) AS segment, avg(CAST(x >= y AS INT)) < 0.5 AS swapped FROM s GROUP BY 1, 2")
def heading_votes(spark, sf_dir):
    return stops.heading_votes(with_segments(observations(spark, sf_dir), 14400), F.col("x"), F.col("y"))


@query("""WITH a AS (SELECT l_orderkey AS item, l_returnflag AS answer, l_suppkey AS who FROM lineitem) SELECT item, CASE WHEN count(DISTINCT answer) = 1 THEN max(answer) ELSE 'disagreement' END AS answer, count(*) AS n FROM a GROUP BY item""")
def curated_answers(spark, sf_dir):
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("answer"))
    return matching.curated_answers(answers, "item", "answer")


@query("""SELECT o_orderkey AS item, CAST(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 2 ELSE 1 END AS INT) AS place FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)""")
def next_to_screen(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").cast("string").alias("user"))
    return matching.unanswered(items, answers, "item", "user", "7")


@query(f"""WITH {E_SQL}, born AS (SELECT f0 AS frame, CAST(0 AS BIGINT) AS a, node_id AS b FROM n WHERE node_id NOT IN (SELECT dst FROM e)) SELECT * FROM born UNION ALL SELECT fN, node_id, coalesce(dst, 0) FROM n LEFT JOIN e ON src = node_id""")
def lost_and_found_pairs(spark, sf_dir):
    nodes = cut(track_degrees(tracks(spark, sf_dir), WITHIN).withColumns({"born_f": F.col("f0"), "died_f": F.col("fN")}))
    return sinks.lost_and_found_known(nodes, track_edges(nodes, WITHIN, src=("died_f",)))


@query(f"""WITH {T_SQL}, r AS (SELECT CASE WHEN bid % 3 = 0 THEN bid - bid % 9 ELSE bid END AS node_id, bid, CAST(floor(time / 3600) AS BIGINT) AS hour, frame FROM t) SELECT node_id, hour, bid FROM (SELECT *, row_number() OVER (PARTITION BY node_id, hour ORDER BY bid * 1000000 + frame) AS k FROM r) WHERE k = 1""")
def corrected_tracks(spark, sf_dir):
    """The first row of each merged object's hour."""
    obs = observations(spark, sf_dir).select("bid", F.floor(F.col("time") / 3600).alias("hour"), (F.col("bid") * 1_000_000 + F.col("frame")).alias("arrival"))
    members = obs.where("bid % 3 = 0").select("bid", (F.col("bid") - F.col("bid") % 9).alias("node_id")).distinct()
    first, _ = sinks.corrected_rows(obs, members, frame="hour", order="arrival")
    return first.select("node_id", "hour", "bid")


@query("""WITH c AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT * FROM c""")
def upsert_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sinks.upsert(rows, rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query(f"WITH {T_SQL} SELECT bid, frame, CAST(ntile(4) OVER (PARTITION BY bid ORDER BY frame) AS INT) AS part FROM t")
def split_parts(spark, sf_dir):
    return sinks.split_parts(observations(spark, sf_dir), 4, "bid", "frame").select("bid", "frame", "part")


#: Two-in-two-out tracks with none beside them: the smaller parent and child, the larger parent and child; of pairs with one child the smallest.
UNTANGLED = """d_ AS (SELECT node_id, (SELECT count(*) FROM e WHERE dst = node_id) AS n_in, (SELECT count(*) FROM e WHERE src = node_id) AS n_out FROM n),
two AS (SELECT node_id FROM d_ WHERE n_in = 2 AND n_out = 2), iso AS (SELECT node_id FROM two WHERE node_id NOT IN (SELECT src FROM e WHERE dst IN (SELECT node_id FROM two)) AND node_id NOT IN (SELECT dst FROM e WHERE src IN (SELECT node_id FROM two))),
pr AS (SELECT i.node_id AS collision, (SELECT min(src) FROM e WHERE dst = i.node_id) AS parent, (SELECT min(dst) FROM e WHERE src = i.node_id) AS child FROM iso i UNION ALL SELECT i.node_id, (SELECT max(src) FROM e WHERE dst = i.node_id), (SELECT max(dst) FROM e WHERE src = i.node_id) FROM iso i),
once AS (SELECT child, (min((collision, parent)))[2] AS parent FROM pr GROUP BY child), gone AS (SELECT DISTINCT q.collision FROM (SELECT child, min((collision, parent)) AS m FROM pr GROUP BY child) o JOIN pr q ON q.child = o.child AND (q.collision, q.parent) = o.m),
h AS (SELECT child AS old, parent AS new, 1 AS d FROM once UNION ALL SELECT h.old, o.parent, d + 1 FROM h JOIN once o ON o.child = h.new),
m AS (SELECT old, arg_max(new, d) AS new FROM h GROUP BY old), v AS (SELECT node_id, coalesce(new, node_id) AS head FROM n LEFT JOIN m ON old = node_id WHERE node_id NOT IN (SELECT collision FROM gone)),
f AS (SELECT DISTINCT a.head AS src, b.head AS dst FROM e JOIN v a ON a.node_id = src JOIN v b ON b.node_id = dst WHERE a.head <> b.head)"""


@query(f"WITH RECURSIVE {E_SQL}, {UNTANGLED} SELECT head AS node_id, CAST(count(*) AS INT) AS n_parts, (SELECT count(*) FROM f WHERE dst = head) AS n_in, (SELECT count(*) FROM f WHERE src = head) AS n_out FROM v GROUP BY head")
def untangled(spark, sf_dir):
    """Two-in-two-out tracks dissolved: the smaller parent goes on as the smaller child, the larger as the larger."""
    nodes, pairs = crossings(spark, sf_dir, alone=True)
    once = pairs.groupBy("child").agg(F.min(F.struct("collision", "parent")).alias("m")).select(F.col("m.collision").alias("collision"), F.col("m.parent").alias("parent"), "child")
    return changed_around(nodes, pairs, lambda graph: g.untangle(graph, once))
