"""Findings that showed on larger tables: rounding, and results without the rows that grow with the square of the tracks."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.operators import graph as g
from trackloom.operators import motion
from trackloom.plans import catalogue, graph_queries

SF = "/root/testdata/sf0.001"


def events(path, rows):
    """A folder with an events table of (user_id, seconds, event_type, value, k)."""
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for i, (bid, s, kind, x, k) in enumerate(rows):
        c.execute("INSERT INTO e VALUES (?, TIMESTAMP '2024-01-01' + to_microseconds(?), ?, ?, ?, ?)", [i, round(s * 1e6), bid, kind, x, f'{{"k": {k}}}'])
    c.execute(f"COPY e TO '{path}/events.parquet'")
    c.execute("ALTER TABLE e RENAME TO events")
    return c, str(path)


def same(spark, made, name):
    c, path = made
    out = catalogue.queries()[name](spark, path)
    want = c.execute(catalogue.oracle_sql()[name]).fetchall()
    names = [d[0] for d in c.description]
    got = [tuple(r[n] for n in names) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_extents_of_ten_but_for_rounding(spark, tmp_path):
    """(x_max - x_min) + (y_max - y_min) as the SQL adds it up."""
    rng, rows = random.Random(1), []
    while len(rows) < 80:
        a, b, k, m = rng.randrange(10000) / 100, rng.randrange(10000) / 100, rng.randrange(90), rng.randrange(9)
        if a < b and ((b - a) + (float(k + m) - float(k)) >= 10) != (b - a + (k + m) - k >= 10):
            rows += [(len(rows), 10.0, "view", a, k), (len(rows), 4000.0, "view", b, k + m)]
    made = events(tmp_path, rows)
    same(spark, made, "cleanup_report")
    same(spark, made, "tracks_over_hours")


def test_outliers_among_almost_equal_speeds(spark):
    """whether a speed is far from nine that differ by rounding alone hangs on the last bit."""
    rng = random.Random(2)
    rows = [(b, 0, t, v + rng.choice([-2, -1, 0, 0, 0, 1, 9]) * math.ulp(v)) for b in range(60) for v in [rng.uniform(0.1, 9)] for t in range(60)]
    got = {(r.bid, r.tick) for r in motion.drop_outliers(spark.createDataFrame(rows, "bid long, segment long, tick long, v double"), "v", rounds=1, least_rows=12).collect()}
    want = set()
    for b in range(60):
        s = [r[3] for r in rows if r[0] == b]
        for i, v in enumerate(s):
            n, mean, squares, near = 0, 0.0, 0.0, s[max(0, i - 5) : i + 5]
            for x in near:
                n += 1
                after = mean + (x - mean) / n
                squares, mean = squares + (x - after) * (x - mean), after
            total = 0.0
            for x in near:
                total += x
            spread = math.sqrt(squares / n)
            if not (abs(v - total / n) > 2.3263 * spread and spread > 0 and 5 <= i < 55):
                want.add((b, i))
    assert len(want) < len(rows) and got == want


def test_speed_of_powers(spark):
    """speeds by the root of C's powers, bit by bit."""
    rng = random.Random(3)
    rows = [(b, 0, float(t), rng.uniform(0, 100), rng.uniform(0, 100)) for b in range(100) for t in range(40)]
    df = motion.segment_speed(spark.createDataFrame(rows, "bid long, segment long, time double, x double, y double"), 1.0, 1, remove_outliers=False)
    at = {(r[0], int(r[2])): r[3:] for r in rows}
    got = df.select("bid", F.col("tick").cast("long").alias("t"), "speed").collect()
    assert len(got) > 3000
    for r in got:
        (x, y), (u, v) = at[r.bid, r.t], at[r.bid, r.t - 1]
        assert r.speed == math.sqrt(math.pow(x - u, 2.0) + math.pow(y - v, 2.0))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_no_table_is_broadcast_by_a_guess(spark):
    """the planner took the part graph for as small as its compressed input and gathered it on the driver."""
    nodes, edges = g.settle(graph_queries.diamond_graph(spark, SF))
    assert "BroadcastHashJoin" not in g.split_joins((nodes, edges))._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_collisions_without_all_edges(spark, monkeypatch):
    """only the edges of collisions, and of those that they merge, are made."""
    from trackloom.plans import scan_queries

    make = graph_queries.track_edges

    def few(nodes, within, to=None):
        assert to is not None
        return make(nodes, within, to=to)

    monkeypatch.setattr(graph_queries, "track_edges", few)
    for name in ("dissolved_collisions", "untangled"):
        assert catalogue.queries()[name](spark, SF).columns[:2] == ["node_id", "n_parts"]
    plan = lambda name: getattr(scan_queries, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan("relinked_edges")  # edges pass through
    assert "step" not in plan("relinked_nodes")
