import random

from pyspark.sql import functions as F

from trackloom.operators import matching, reports, stops
from trackloom.streaming import tracks as live


def test_best_assignment():
    over = {(1, 10): 5, (1, 11): 9, (2, 10): 8, (2, 11): 1}
    assert matching.best_assignment(over, [1, 2], [10, 11]) == [(1, 11), (2, 10)]
    assert matching.best_assignment({(1, 10): 5, (2, 11): 4, (2, 12): 3}, [1, 2], [10, 11, 12]) == [(1, 10), (2, 11), (2, 12)]
    assert matching.best_assignment({(1, 10): 5, (2, 11): 4, (3, 11): 3}, [1, 2, 3], [10, 11]) == [(1, 10), (2, 11), (3, 11)]


def test_assign_groups(spark):
    rows = [(7, 1, 10, 5), (7, 1, 11, 9), (7, 2, 10, 8), (8, 3, 12, 1)]
    got = matching.assign_groups(spark.createDataFrame(rows, "c long, p long, k long, n long"), "c", "p", "k", "n").collect()
    assert sorted((r.c, r.p, r.k) for r in got) == [(7, 1, 11), (7, 2, 10), (8, 3, 12)]


def test_flagged_band(spark):
    rows = spark.createDataFrame([(1, t / 10) for t in range(20)] + [(2, 0.5), (3, None)], "bid long, time double")
    flagged = spark.createDataFrame([(1, 0.52), (1, 1.0)], "bid long, time double")
    got = matching.without_flagged(rows, flagged, "bid", "time", 0.05)
    assert sorted(r.time for r in got.where("bid = 1").collect()) == [t / 10 for t in range(20) if t not in (5, 10)]
    assert got.where("bid != 1").count() == 2


def test_stops(spark):
    r, rows, x = random.Random(1), [], 0.0
    for k in range(120):
        x += 0 if 40 <= k < 90 else 1
        rows.append((1, k, x + r.uniform(-0.01, 0.01), 0.0))
    df = spark.createDataFrame(rows, "bid long, frame long, x double, y double")
    found = stops.stop_intervals(df, 0.25, 10)
    (stop,) = found.collect()
    assert (stop.start, stop.end) == (39, 89)
    table = stops.moves_and_stops(found, spark.createDataFrame([(1, 0, 119), (2, 5, 9)], "bid long, low long, high long"))
    assert sorted((t.bid, t.start, t.end, t.moving) for t in table.collect()) == [(1, 0, 39, True), (1, 39, 89, False), (1, 89, 119, True), (2, 5, 9, True)]
    kept = sorted(r.frame for r in stops.thin_stops(df, found).collect())
    assert kept == [*range(40), *range(89, 120)]


def test_fill_frames(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 4, 8.0), (1, 5, 9.0)], "bid long, frame long, x double")
    assert [(r.frame, r.x) for r in stops.fill_frames(df, ["x"]).orderBy("frame").collect()] == [(0, 0.0), (1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0)]


def test_reports(spark):
    cards = spark.createDataFrame([(0, "a", "raw", 110), (1, "b", "x", 60), (2, "b", "y", 35)], "order int, phase string, step string, total_nodes long")
    assert {r.phase: r.change for r in reports.changes_by_phase(cards).collect()} == {"a": 0, "b": 75}
    assert reports.removed_share(cards, 10).first().removed == 75.0


def test_streams(spark, tmp_path):
    rows = [(k, 1000 + k * 60 if k < 5 else 50_000 + k * 60, k % 2) for k in range(10)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "in/events.parquet"))
    stream = lambda: live.event_stream(spark, str(tmp_path / "in/events.parquet").removesuffix("/events.parquet"))
    source = spark.readStream.schema(live.EVENTS).parquet(str(tmp_path / "in/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    stitched = live.run_to_end(live.stitch(source), str(tmp_path / "out"))
    assert {(r.user_id, r.track) for r in stitched.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    sessions = live.run_to_end(live.sessions(source), str(tmp_path / "sessions"), "complete")
    assert sessions.count() == 4 and stream().isStreaming


def test_assignments_are_the_best():
    import itertools
    import random

    r = random.Random(3)
    for n, m in [(1, 1), (2, 2), (3, 5), (5, 5), (4, 6), (6, 3)]:
        over = {(i, 10 + j): r.randrange(20) for i in range(n) for j in range(m) if r.random() < 0.8}
        pairs = matching.best_assignment(over, list(range(n)), list(range(10, 10 + m)))
        assert len(pairs) == max(n, m)
        one = max(sum(over.get((i, 10 + j), 0) for i, j in zip(range(n), way)) for way in itertools.permutations(range(m), n)) if n <= m else max(sum(over.get((i, 10 + j), 0) for j, i in zip(range(m), way)) for way in itertools.permutations(range(n), m))
        few = set(range(n)) if n <= m else set(range(10, 10 + m))
        side = 0 if n <= m else 1
        best = sum(max([over.get(p, 0) for p in pairs if p[side] == x]) for x in few)
        assert best >= one and sum(over.get(p, 0) for p in pairs) >= one
    big = {(i, 100 + j): float(i == j) for i in range(40) for j in range(40)}
    assert matching.best_assignment(big, list(range(40)), list(range(100, 140))) == [(i, 100 + i) for i in range(40)]
