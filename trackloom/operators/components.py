"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.hotkeys import attach
from trackloom.plans.lineage import cut


HUB = 1000  # edges of a node that may go to one task, beside a task's share of all


def _state(edges: DataFrame) -> tuple:
    """(edges, their hash sum, edges of the busiest node)"""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.xxhash64("src", "dst").cast("decimal(20,0)").alias("hash"))
    found = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("hash").alias("hash")).agg(F.sum("n"), F.sum("hash"), F.max("n")).first()
    return (found[0] or 0) // 2, found[1], found[2] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of each node that has an edge to another.

    Alternating star contraction: the number of rounds grows with the logarithm
    of the longest path, and no node's neighbours are ever gathered in one row.
    While some node has more edges than a task's share, joins deal the edges of
    each node over many tasks. Null ends and loops are left out.
    """
    now = cut(edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")).distinct())
    state = _state(now)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in range(max_rounds):
        if not state[0]:
            break
        join = attach if state[2] > max(HUB, state[0] // parts) else lambda rows, values, on, spread_by: rows.join(values, on)
        both = now.union(now.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("low", "src").alias("low"))
        larger = now.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        large = join(larger, least, ["src"], ["dst"]).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = join(large, least, ["src"], ["dst"]).select("dst", "low").where("dst != low").union(least).toDF("src", "dst").distinct()
        now = cut(small)
        if n > 1 and n % 2 == 0:  # long paths: look at every second round only
            continue
        was, state = state, _state(now)
        if was[:2] == state[:2]:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())
