import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import images, models, readings, series, stats, tracks


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = list(zip([1] * n, range(n), *columns.values()))
    return spark.createDataFrame(rows, ["bid", "frame", *columns])


def column(df, name):
    return [r[name] for r in df.orderBy("frame").collect()]


def flags(off, n=1000):
    return [k not in off for k in range(n)]


def test_breaks(spark):
    times = [k / 10 for k in range(1000)]
    gaps = lambda good: sorted((r.start, r.end) for r in series.bad_intervals(frame(spark, time=times, good=good), "good").collect())
    assert gaps(flags({250, 500, 750})) == []
    assert gaps([False] * 1000) == [(0, 99.9)]
    toggle = [(k // 250) % 2 == 0 for k in range(1000)]
    assert gaps(toggle) == [(25.0, 49.9), (75.0, 99.9)]
    assert gaps([not x for x in toggle]) == [(0, 24.9), (50.0, 74.9)]


def test_flags_and_runs(spark):
    df = frame(spark, good=[True, True, False, True, True, True, True, False])
    assert column(series.run_lengths(df, "good"), "run") == [2, 2, 0, 4, 4, 4, 4, 0]
    assert column(series.keep_long_runs(df, "good", 4), "ok") == [False] * 3 + [True] * 4 + [False]
    loner = frame(spark, good=flags({250, 500, 750}))
    assert all(column(series.forgive_loners(loner, "good"), "ok"))


def test_turning_constant(spark):
    t = np.arange(30) * 0.2
    df = frame(spark, x=np.cumsum(np.cos(t)).tolist(), y=np.cumsum(np.sin(t)).tolist(), time=t.tolist())
    angles = column(series.turning_angle(df), "angle")
    assert angles[0] is None and angles[-1] is None
    assert all(abs(a - 0.2) < 1e-9 for a in angles[1:-1])


def test_unwrap_and_speed(spark):
    a = [float(x) for x in np.angle(np.exp(1j * np.arange(0, 20, 0.5)))]
    got = column(series.unwrap_angle(frame(spark, a=a), "a"), "unwrapped")
    assert np.allclose(got, np.arange(0, 20, 0.5))
    df = frame(spark, x=[0.0, 3.0, 3.0], y=[0.0, 4.0, 4.0], time=[0.0, 1.0, 1.0])
    assert column(series.speed(df), "speed") == [None, 5.0, None]
    assert column(series.speed_floor(df), "speed") == [5.0, 0.0, None]


def test_interpolation(spark):
    df = frame(spark, time=[0.5, 2.5, 5.0], x=[0.0, 2.0, 7.0])
    got = [(r.tick, r.x) for r in series.interpolate_grid(df, 1.0, ["x"]).orderBy("tick").collect()]
    assert got == [(1, 0.5), (2, 1.5), (3, 3.0), (4, 5.0)]


def test_savgol(spark):
    x = np.arange(40.0)
    y = 0.5 * x * x - 3 * x + 2
    got = np.array(column(models.savgol(frame(spark, y=y.tolist()), "y", 7, 2), "smooth"))
    assert np.allclose(got[3:-3], y[3:-3])
    padded = np.concatenate([y[0] - np.abs(y[1:4][::-1] - y[0]), y, y[-1] + np.abs(y[-4:-1][::-1] - y[-1])])
    assert np.allclose(got, np.convolve(padded, models.savgol_weights(7, 2)[::-1], "valid"))
    assert column(models.savgol(frame(spark, y=[1.0, 2.0]), "y", 7, 2), "smooth") == [None, None]


def test_states_and_segments(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, 80), r.normal(8, 1, 60), r.normal(0, 1, 40)])
    df = frame(spark, x=x.tolist())
    states = column(models.hidden_states(df, "x", keys=("bid",)), "state")
    assert np.mean(np.array(states) == np.repeat([0, 1, 0], [80, 60, 40])) > 0.98
    cuts = sorted(row["first"] for row in models.segments(df, "x", keys=("bid",)).collect())
    assert len(cuts) == 3 and abs(cuts[1] - 80) < 4 and abs(cuts[2] - 140) < 4
    assert models.segment(r.normal(0, 1, 100)) == [0]


def test_special_functions():
    assert models.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert models.beta_inc(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    assert models.beta_inc(7.6, 0.4, 0.99) == pytest.approx(1 - models.beta_inc(0.4, 7.6, 0.01))


def test_cure(spark):
    r = np.random.default_rng(2)
    points = np.concatenate([c + 0.05 * r.normal(size=(30, 3)) for c in np.eye(3)])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, v array<double>")
    got = {x.id: x.cluster for x in models.cure(df, "v", 3, "id").collect()}
    assert [len({got[k] for k in range(g * 30, g * 30 + 30)}) for g in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    got = {x.id: x.cluster for x in models.cure(df, "v", 3, "id", part_rows=25, partial=2).collect()}  # several parts and rounds
    assert [len({got[k] for k in range(g * 30, g * 30 + 30)}) for g in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    assert models.cure(df.limit(0), "v", 3, "id").count() == 0


def test_ks(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(0, 1, 300).round(2), r.normal(0.5, 1, 200).round(2)
    df = spark.createDataFrame([(float(v), "a") for v in a] + [(float(v), "b") for v in b], "v double, s string")
    every = np.union1d(a, b)
    want = np.abs(np.searchsorted(np.sort(a), every, side="right") / 300 - np.searchsorted(np.sort(b), every, side="right") / 200).max()
    assert stats.ks_two_sample(df, "v", F.col("s") == "a", 0.3).first().ks == pytest.approx(want)
    assert stats.ks_all_pairs(df, "v", "s", 0.3).first().ks == pytest.approx(want)


GAPS = [(5, 1, 1, 6, 4, 0, True), (5, 0, 6.1, 6, 6, 0, False), (5, 6.1, 0, 6, 6, 0, False), (6, 0, 0, 6, 6, 0, False), (-20, 1, 1, 6, 20, 30, True), (-3, 1, 1, 6, 6, 2, False)]


@pytest.mark.parametrize("df,dx,dy,max_df,max_dist,slack,found", GAPS)
def test_gap_candidates(spark, df, dx, dy, max_df, max_dist, slack, found):
    rows = [(10, 0.0, 100.0, 0.0, 0.0, 300.0, 200.0), (20, 100.0 + df, 500.0, 300.0 + dx, 200.0 + dy, 900.0, 900.0)]
    t = spark.createDataFrame(rows, "node_id long, t0 double, tN double, x0 double, y0 double, xN double, yN double")
    got = {(r.node1, r.node2) for r in tracks.gap_candidates(t, max_df, max_dist, slack).collect()}
    assert ((10, 20) in got) == found


def test_nearest_in_time(spark):
    r = np.random.default_rng(4)
    left, right = r.uniform(0, 5e5, 80).round(1), r.uniform(1e5, 4e5, 60).round(1)
    l = spark.createDataFrame([(k, float(t)) for k, t in enumerate(left)], "id long, t double")
    rr = spark.createDataFrame([(k, float(t)) for k, t in enumerate(right)], "other long, s double")
    got = {x.id: x.distance for x in tracks.nearest_in_time(l, rr, "t", "s", "id", ["other"], 10.0).collect()}
    assert got == {k: pytest.approx(np.abs(right - t).min()) for k, t in enumerate(left)}


def test_masks(spark):
    square = [(x, 0) for x in range(6)] + [(5, y) for y in range(1, 6)] + [(x, 5) for x in range(4, -1, -1)] + [(0, y) for y in range(4, 0, -1)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in square]), (2, None)], "id long, ps array<struct<x:int,y:int>>")
    pixels = images.mask_pixels(df, "ps", "id")
    assert pixels.count() == 36
    bar = spark.createDataFrame([(7, x, y) for x in range(30) for y in range(5)], "id long, x int, y int")
    row = images.skeletons(bar, "id").first()
    assert row.pixels == 150 and row.thin < 40 and row.ends == 2 and row.branches == 0
    two = spark.createDataFrame([(1, x, 0) for x in (0, 1, 2, 5, 6)], "id long, x int, y int")
    assert sorted(r.pixels for r in images.pixel_components(two, "id").collect()) == [2, 3]


def test_exact_quantiles(spark):
    r = np.random.default_rng(6)
    x = [float(v) for v in r.normal(0, 3, 501).round(1)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double")
    got = {q.share: q.value for q in stats.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    assert got == {p: pytest.approx(float(np.quantile(x, p))) for p in (0.0, 0.1, 0.5, 0.77, 1.0)}
    assert stats.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert stats.exact_quantiles(spark.createDataFrame([(2.0,)], "v double"), "v", [0.5]).first().value == 2.0


def test_turns_of_steps_of_no_length(spark):
    """Beside a step back on both axes the inner product is -0, and C's atan2 gives half a turn."""
    df = frame(spark, x=[5.0, 5.0, 3.0, 3.0, 7.0, 7.0], y=[5.0, 5.0, 2.0, 2.0, 1.0, 9.0], time=[0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    want = [np.pi, np.pi, 0.0, np.pi / 2 + np.arctan2(1.0, 4.0)]
    assert np.allclose(column(series.turning_angle(df), "angle")[1:-1], want)
    assert np.allclose(column(stats.markov_measures(df), "turn")[2:], want)
    assert np.isclose(readings.track_statistics(df).first()["turned"], sum(want))
