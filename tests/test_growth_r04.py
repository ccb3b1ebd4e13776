"""Pairs that grow with the square of the tracks are neither shuffled nor joined again."""

import collections
import datetime
import math
import random

import pytest

import __spark_entry__ as e
from trackloom.operators import images
from trackloom.operators import tracks as op


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """40 objects' events in six days: tracks of some hours, many of them in reach of each other."""
    rnd, at = random.Random(4), str(tmp_path_factory.mktemp("events"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=rnd.uniform(0, 518400)), int(40 * rnd.random() ** 2), rnd.choice(["click", "view", "purchase"]), float(rnd.randrange(30)), f'{{"k": {rnd.randrange(30)}}}') for k in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return at


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    want = con.sql(e.oracle_sql()[name])
    df = e.queries()[name](spark, sf_dir)
    got = sorted(tuple(r[c] for c in want.columns) for r in df.collect())
    assert got and got == sorted(want.fetchall())
    return df


@pytest.mark.parametrize("name", ["pair_attributes", "validate_acausal", "relevant_subgraph"])
def test_edges_are_made_by_one_join(spark, sf_dir, name):
    assert joins(matches_sql(spark, sf_dir, name)) == 1


def test_gap_lines_shuffle_no_pairs(spark, sf_dir):
    assert joins(matches_sql(spark, sf_dir, "gap_lines")) == 0


def test_nearest_in_time_makes_no_pairs(spark):
    left = spark.createDataFrame([(k, float(k % 50)) for k in range(1000)], "id long, time double")
    right = spark.createDataFrame([(float(k % 40) + 0.5, k) for k in range(1000)], "seen double, other long")
    found = op.nearest_in_time(left, right, "time", "seen", "id", ["other"], 100.0)
    rows = {r.id: (r.distance, r.seen, r.other) for r in found.collect()}
    for k in range(1000):
        d, seen, other = min((abs(float(j % 40) + 0.5 - k % 50), float(j % 40) + 0.5, j) for j in range(1000))
        assert rows[k] == (d, seen, other)
    assert joins(found) == 4  # left rows only with their step's row, and tables of steps


def test_pairs_leave_a_stretch_in_parts(spark, sf_dir):
    """A stretch's pairs, far more than its ends and starts, are never one table of a task."""
    plan = matches_sql(spark, sf_dir, "gap_candidates")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_parts_are_not_gathered_on_the_driver(spark, tmp_path):
    rows = [(k, k % 50) for k in range(500) if k % 7]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = e.queries()["split_joins"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.a for r in df.collect()) == [4 * k for k, size in rows if size + 3 <= 25]


def test_tracked_ones_look_into_few_cells(spark):
    rnd = random.Random(2)
    objects = [(1, float(rnd.randrange(60)) / 2, float(rnd.randrange(60)) / 2) for _ in range(80)]
    tracked = [(1, k, float(rnd.randrange(60)) / 2, float(rnd.randrange(60)) / 2) for k in range(200)]
    found = images.scan_matches(spark.createDataFrame(objects, "image int, x double, y double"), spark.createDataFrame(tracked, "image int, bid int, x double, y double"), "image", 3.0)
    taken = [min(((math.hypot(x - a, y - b), a, b) for _, a, b in objects if math.hypot(x - a, y - b) <= 3.0), default=None) for _, _, x, y in tracked]
    counts = collections.Counter(m[1:] for m in taken if m)
    n = sum(counts.values())
    r = found.first()
    assert (r.true_pos, r.false_neg, r.false_pos, r.joined) == (n, len(objects) - len(counts), len(tracked) - n, sum(c > 1 for c in counts.values()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" in plan
