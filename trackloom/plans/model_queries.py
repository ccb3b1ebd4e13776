"""Queries of the model, mask and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators import images, models
from trackloom.plans.lineage import shared_dir
from trackloom.plans.registry import query
from trackloom.sources.tracks import S_SQL, T_SQL, observations, table, with_segments
from trackloom.streaming import tracks as live

r6 = lambda c: F.round(c, 6) + 0.0
LONG_PAUSE = 24 * 3600
WEIGHTS = models.savgol_weights(5, 2)
SAVGOL = " + ".join(f"({c!r}) * " + ("x" if k == 0 else f"{'lag' if k < 0 else 'lead'}(x, {abs(k)}) OVER w") for k, c in zip(range(-2, 3), WEIGHTS))


@query(f"""WITH {T_SQL}, k AS (SELECT bid, frame, {SAVGOL} AS smooth, count(*) OVER (PARTITION BY bid) AS n FROM t WINDOW w AS (PARTITION BY bid ORDER BY frame))
SELECT bid, frame, round(smooth, 6) + 0.0 AS smooth FROM k WHERE frame > 2 AND frame <= n - 2""")
def savgol(spark, sf_dir):
    """Full windows only: where the padding of the ends plays no part."""
    out = models.savgol(observations(spark, sf_dir), "x", 5, 2)
    last = out.groupBy("bid").agg(F.max("frame").alias("n"))
    return out.join(last, "bid").where("frame > 2 and frame <= n - 2").select("bid", "frame", r6("smooth").alias("smooth"))


@query()
def hmm_states(spark, sf_dir):
    return models.hidden_states(with_segments(observations(spark, sf_dir), LONG_PAUSE), "x")


@query()
def segmentation(spark, sf_dir):
    return models.segments(with_segments(observations(spark, sf_dir), LONG_PAUSE), "x").withColumn("mean", r6("mean"))


@query()
def slope_segmentation(spark, sf_dir):
    """Stretches of all of an object's values that differ in level and in slope over time."""
    out = models.slope_segments(observations(spark, sf_dir).withColumn("day", F.col("time") / 86400), "day", "x", keys=("bid",))
    return out.select("bid", "first", "last", "n", r6("mean").alias("mean"), r6("slope").alias("slope"))


@query()
def cure(spark, sf_dir):
    return models.cure(table(spark, sf_dir, "embeddings"), "embedding", 8, "vec_id")


@query()
def bootstrap_ks(spark, sf_dir):
    return models.bootstrap_exponential(observations(spark, sf_dir), "x", "kind", 20, 0.1)


@query(f"""WITH {T_SQL}, r AS (SELECT bid, x, avg(x) OVER (PARTITION BY bid) AS scale, count(*) OVER (PARTITION BY bid) AS n, row_number() OVER (PARTITION BY bid ORDER BY x) AS i FROM t WHERE x >= 0)
SELECT bid, round(max(greatest(abs(i / n - (1 - exp(-x / scale))), abs((i - 1) / n - (1 - exp(-x / scale))))), 6) AS ks FROM r GROUP BY bid""")
def exponential_ks(spark, sf_dir):
    return models.exponential_ks(observations(spark, sf_dir), "x", "bid").select("bid", r6("ks").alias("ks"))


MASKS = "SELECT DISTINCT {key} AS id, CAST(l_quantity AS INT) AS x, CAST(round(l_discount * 100) AS INT) AS y FROM lineitem"


def _masks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"))
    return rows.withColumnRenamed("l_suppkey", "parent"), rows.select((F.col("l_partkey") % 40).alias("child"), "x", "y")


@query(f"WITH p AS ({MASKS.format(key='l_suppkey')}), c AS ({MASKS.format(key='l_partkey % 40')}) SELECT p.id AS parent, c.id AS child, count(*) AS pixels FROM p JOIN c USING (x, y) GROUP BY 1, 2")
def mask_overlap(spark, sf_dir):
    parents, children = _masks(spark, sf_dir)
    return images.overlaps(parents, children, "parent", "child")


@query(f"""WITH p AS ({MASKS.format(key='l_suppkey')}), c AS ({MASKS.format(key='l_partkey % 40')}), o AS (SELECT p.id AS parent, c.id AS child, count(*) AS n FROM p JOIN c USING (x, y) GROUP BY 1, 2),
k AS (SELECT parent // 2 AS collision, coalesce(sum(n) FILTER (parent % 2 = child % 2), 0) AS straight, coalesce(sum(n) FILTER (parent % 2 <> child % 2), 0) AS crossed FROM o WHERE child // 2 = (parent // 2) % 20 GROUP BY 1)
SELECT collision, CAST(straight AS BIGINT) AS straight, CAST(crossed AS BIGINT) AS crossed, CASE WHEN straight - crossed > 10 THEN 'straight' WHEN crossed - straight > 10 THEN 'crossed' ELSE 'open' END AS verdict FROM k""")
def mask_pairs(spark, sf_dir):
    """Two suppliers and two part classes each as parents and children of a collision."""
    parents, children = _masks(spark, sf_dir)
    found = images.overlaps(parents, children, "parent", "child")
    found = found.withColumn("collision", F.floor(F.col("parent") / 2)).where(F.floor(F.col("child") / 2) == F.col("collision") % 20)
    return images.resolve_pairs(found.select("collision", (F.col("parent") % 2).alias("p"), (F.col("child") % 2).alias("c"), "pixels"), "collision", 10)


@query()
def mask_skeletons(spark, sf_dir):
    parents, _ = _masks(spark, sf_dir)
    return images.skeletons(parents.select("parent", "x", "y"), "parent")


@query()
def mask_objects(spark, sf_dir):
    parents, _ = _masks(spark, sf_dir)
    return images.pixel_components(parents.select("parent", "x", "y"), "parent")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_bins(spark, sf_dir):
    out = live.run_to_end(live.bins(live.event_stream(spark, sf_dir)), f"{shared_dir(spark)}/bins-{uuid.uuid4().hex}", "complete")
    return out.withColumn("value", F.round("value", 4))


@query("""WITH g AS (SELECT user_id, ts, CAST(ts >= lag(ts) OVER w + INTERVAL 4 HOUR AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return live.run_to_end(live.sessions(live.event_stream(spark, sf_dir)), f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}", "complete")


@query(f"WITH {S_SQL.replace('event_type AS kind FROM', 'event_type AS kind, event_id FROM')} SELECT bid AS user_id, event_id, CAST(segment AS BIGINT) AS track FROM s")
def stream_stitch(spark, sf_dir):
    return live.run_to_end(live.stitch(live.event_stream(spark, sf_dir)), f"{shared_dir(spark)}/stitch-{uuid.uuid4().hex}")
