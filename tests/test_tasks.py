from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import enclosure, flags, motion, state_fits
from trackloom.operators.batches import in_tasks
from trackloom.plans import flag_queries, motion_queries, scan_queries, state_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_in_number(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert in_tasks(df, 1000, 10, "k").rdd.getNumPartitions() == 100
    assert in_tasks(df, 10, 1000, "k").rdd.getNumPartitions() == 1
    assert in_tasks(df, 0, 10, "k").rdd.getNumPartitions() == 1


def test_plates_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(scan_queries, "PLATES", 1)
    images = spark.read.parquet(f"{SF}/supplier.parquet").count()
    pixels = scan_queries.plates(spark, SF)
    assert pixels.rdd.getNumPartitions() == images
    dark = enclosure.opened(pixels.withColumn("dark", F.col("value") < F.avg("value").over(Window.partitionBy("image"))), "dark", 3)
    assert plan(dark).count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan(dark)


def test_speeds_in_many_tasks(spark, monkeypatch):
    want = motion_queries.segment_speed(spark, SF).collect()
    monkeypatch.setattr(motion_queries, "OBSERVATIONS", 5)
    got = motion_queries.segment_speed(spark, SF)
    assert sorted(got.collect()) == sorted(want) and got.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/events.parquet").count() // 5)
    slow = plan(motion_queries.speed_of_slow(spark, SF))
    assert slow.count("Exchange ") == 2 and "Join" not in slow


def test_slow_objects(spark):
    rows = [(1, 5.0), (1, 30.0), (2, 20.0), (2, None), (None, 1.0), (3, None)]
    got = motion.slow_enough(spark.createDataFrame(rows, "bid long, speed double"), 20)
    assert sorted(tuple(r) for r in got.where("speed is not null").collect()) == [(2, 20.0)] and got.count() == 2


def test_fits_in_many_tasks(spark, monkeypatch):
    found = []
    monkeypatch.setattr(state_fits, "in_tasks", lambda df, rows, most, *keys: found.append((rows, most)) or in_tasks(df, rows, most, *keys))
    state_queries.fitted_states(spark, SF)
    assert found[0][0] > 0 and found[0][1] == state_fits.SERIES


def test_resampled_paths_keep_no_arrays(spark):
    got = flag_queries.resampled_paths(spark, SF)
    assert "collect_list" not in plan(got)
    points = F.transform(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    old = motion_queries.segments(spark, SF).groupBy("bid", "segment").agg(points.alias("p")).select("bid", "segment", F.posexplode(flags.resample(F.col("p"), 11)).alias("place", "p"))
    want = old.select("bid", "segment", "place", *[(F.round(f"p.{c}", 6) + 0.0).alias(c) for c in "xy"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_spines_are_treated_where_they_are(spark):
    """the points of a spine are no rows of a shuffle, and a shape is looked at once."""
    from trackloom.operators import curves, spines
    from trackloom.operators.models import savgol_weights
    from trackloom.plans import shape_queries

    found = plan(shape_queries.treated_spines(spark, SF))
    assert "collect_list" not in found and "Join" not in found
    rows = [(1, k, float((k * k) % 23), float(k - k % 3)) for k in range(25)] + [(2, k, 3.0 * k, 0.5) for k in range(21)]
    df = spark.createDataFrame(rows, "bid long, place int, x double, y double")
    want = {(r.bid, r.place): (round(r.x, 9), round(r.y, 9)) for r in curves.spaced(curves.smoothed(df, 13, 3), 50).collect()}
    got = {}
    for bid in (1, 2):
        x, y = ([r[c] for r in rows if r[0] == bid] for c in (2, 3))
        line = curves.spaced_line(*(curves.smooth_line(curves.np.array(v), savgol_weights(13, 3)) for v in (x, y)), 50)
        got |= {(bid, k): (round(a, 9), round(b, 9)) for k, (a, b) in enumerate(zip(*(v.tolist() for v in line)))}
    assert got == want and len(got) == 100
    assert curves.spaced_line(curves.np.zeros(3), curves.np.zeros(3), 5) is None
    spines.spine_of_shape.cache_clear()
    outline = [{"x": x, "y": y} for x, y in [(0, 0), (9, 0), (9, 2), (0, 2)]]
    far = [{"x": p["x"] + 70, "y": p["y"] - 9} for p in outline]
    here, there = spines._spines(spines.pd.Series([outline, far])).tolist()
    assert [(p["x"] + 70, p["y"] - 9) for p in here] == [(p["x"], p["y"]) for p in there] and spines.spine_of_shape.cache_info().misses == 1
