"""Sums that reset and centroid paths against plain loops."""

import numpy as np
import pytest
from tests.test_shapes import numpy_savgol

from trackloom.operators import centroid, resets


def plain_resets(times, values, span):
    out, start, since = [], 0, times[0]
    for i in range(len(times) - 1):
        if times[i + 1] >= since + span:
            out.append((start, i, sum(values[start:i]), times[i + 1]))
            start, since = i, times[i + 1]
    return out


@pytest.mark.parametrize("chunk", [None, 7.0, 20.0])
def test_chunks_give_what_one_walk_does(spark, chunk):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for bid in range(25):
        n = int(rng.integers(1, 200))
        steps = rng.choice([0.3, 1.0, 2.5, 9.0, 60.0], size=n, p=[0.4, 0.4, 0.15, 0.04, 0.01])
        times, values = np.cumsum(steps) - 30, rng.normal(size=n)
        rows += [(bid, float(t), float(v), "x") for t, v in zip(times, values)]
        want += [(bid, *r) for r in plain_resets(times.tolist(), values.tolist(), 5.0)]
    rows += [(None, 1.0, 1.0, "x"), (1, None, 1.0, "x"), (1, 1.0, None, "x")]
    df = spark.createDataFrame(rows, "bid int, time double, turn double, chunk string")
    got = sorted((r.bid, r["first"], r["last"], r.total, r.until) for r in resets.resets(df, 5.0, "turn", chunk=chunk).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3:] for g in got], [w[3:] for w in sorted(want)])


def test_no_rows_and_counts(spark):
    empty = resets.resets(spark.createDataFrame([], "bid int, time double, v double"), 5.0, "v")
    assert empty.collect() == []
    found = spark.createDataFrame([(1, 0, 4, 95.0), (1, 4, 9, 10.0), (2, 0, 3, -95.0)], "bid int, first long, last long, total double")
    assert sorted(map(tuple, resets.turn_count(found, 90.0).collect())) == [(1, 2, 1), (2, 1, 0)]
    points = spark.createDataFrame([(1, i, float(i)) for i in range(9)], "bid int, frame long, x double")
    assert [tuple(r) for r in resets.turn_middles(found, points, 90.0).collect()] == [(1, 2, 95.0, 2.0)]


def plain_package(t, x, y, before, least, distance, after, step):
    x, y = numpy_savgol(x, *before), numpy_savgol(y, *before)
    scores = [0] * len(x)
    for i in range(3, len(x)):
        n = 0
        while n < i and np.hypot(x[i - n - 1] - x[i], y[i - n - 1] - y[i]) <= distance:
            n += 1
        scores[i] = n
    stops = []
    for i, s in enumerate(scores):
        if s > least:
            low = i - s
            while stops and stops[-1][1] >= low:
                low = min(low, stops.pop()[0])
            stops.append((low, i))
    for a, b in stops:
        for v in (x, y):
            v[a : b + 1] = np.median(v[a : b + 1])
    x, y = numpy_savgol(x, *after), numpy_savgol(y, *after)
    ticks = np.arange(np.ceil(t[0] / step), np.ceil(t[-1] / step))
    return stops, ticks, np.interp(ticks * step, t, x), np.interp(ticks * step, t, y)


def test_the_package_against_numpy(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for bid in range(3):
        moving = np.repeat(rng.integers(0, 2, 20), 15)
        t = np.cumsum(rng.uniform(0.05, 0.15, 300))
        x, y = (np.cumsum(moving * rng.normal(0.3, 0.2, 300)) + 0.01 * rng.normal(size=300) for _ in range(2))
        rows += [(bid, i + 1, float(t[i]), float(x[i]), float(y[i])) for i in range(300)]
        want[bid] = t, *plain_package(t, x, y, (9, 3), 10, 0.25, (15, 3), 0.1)
    df = spark.createDataFrame(rows, "bid int, frame long, time double, x double, y double")
    path, stretches = centroid.centroid_package(df, (9, 3), 10, 0.25, 500, (15, 3), 0.1)
    path, stretches = path.collect(), stretches.collect()
    for bid, (t, stops, ticks, x, y) in want.items():
        mine = sorted((r.tick, r.x, r.y, r.speed, r.turn) for r in path if r.bid == bid)
        assert [m[0] for m in mine] == ticks.tolist() and np.allclose([m[1:3] for m in mine], np.stack([x, y], axis=1))
        assert np.allclose([m[3] for m in mine[1:]], np.hypot(np.diff(x), np.diff(y)) / 0.1) and mine[0][3] is None
        assert len(stops) > 1
        found = sorted((r.start, r.end) for r in stretches if r.bid == bid and not r.moving)
        assert len(found) == len(stops) and np.allclose(found, [(t[a], t[b]) for a, b in stops])
        assert all(r.seconds == pytest.approx(r.end - r.start) for r in stretches)
