"""Segments by level and slope against the definition."""

import math

import numpy as np
import pytest

from trackloom.operators import models


def plain_t(a, b):
    pooled = ((len(a) - 1) * np.var(a) + (len(b) - 1) * np.var(b)) / (len(a) + len(b) - 2)
    return abs(np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))


def plain_p(a, b):
    return models.t_max_p(plain_t(a, b), len(a) + len(b))


def plain_slope_p(x, y, at):
    """By the residuals of fits with one slope and with two."""
    def left_over(parts, common):
        u = [p[0] - p[0].mean() for p in parts]
        v = [p[1] - p[1].mean() for p in parts]
        if common:
            slope = [sum((a * b).sum() for a, b in zip(u, v)) / sum((a * a).sum() for a in u)] * 2
        else:
            slope = [(a * b).sum() / (a * a).sum() for a, b in zip(u, v)]
        return sum(((b - s * a) ** 2).sum() for a, b, s in zip(u, v, slope))

    parts = [(x[:at], y[:at]), (x[at:], y[at:])]
    two, one, free = left_over(parts, False), left_over(parts, True), len(x) - 4
    return models.beta_inc(free / 2, 0.5, free / (free + (one - two) / two * free))


def plain_segments(x, y, joint, least=6, p=0.05):
    starts = [0]
    while True:
        for k, low in enumerate(starts):
            ends = [*starts[1:], len(y)]
            high, best = ends[k], (0.0, 0)
            for at in range(low + least, high - least + 1):
                t = plain_t(y[low:at], y[at:high])
                if t > best[0]:
                    best = t, at
            at = best[1]
            if not at or models.t_max_p(best[0], high - low) >= p:
                continue
            if k and plain_p(y[starts[k - 1] : low], y[low:at]) >= p:
                continue
            if k + 1 < len(starts) and plain_p(y[at:high], y[high : ends[k + 1]]) >= p:
                continue
            if joint and plain_slope_p(x[low:high], y[low:high], at - low) >= p:
                continue
            starts.insert(k + 1, at)
            break
        else:
            return starts


def data(seed):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.uniform(0.5, 1.5, 160))
    y, level = [], 0.0
    for n in rng.integers(15, 45, 5):
        slope = rng.choice((-0.4, 0.0, 0.4))
        y += list(level + slope * np.arange(n) + rng.normal(0, 0.8, n))
        level += rng.normal(0, 3) + slope * n
    return x[: len(y)], np.array(y[: len(x)])


def test_levels_and_slopes_against_the_definition(spark):
    rows, want = [], {}
    for k in range(14):
        x, y = data(k)
        rows += [(k, 10 + 2 * i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
        want[k] = [[10 + 2 * i for i in plain_segments(x, y, joint)] for joint in (False, True)]
    rows += [(50, 1, 1.0, None), (51, 1, 2.0, 3.0), (52, 1, 1.0, 1.0), (52, 2, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "bid int, frame long, x double, y double")
    for joint, found in ((0, models.segments(df, "y", ("bid",))), (1, models.slope_segments(df, "x", "y", ("bid",)))):
        got = {}
        for r in found.orderBy("bid", "first").collect():
            got.setdefault(r.bid, []).append(r)
        assert {k: [r["first"] for r in got[k]] for k in want} == {k: w[joint] for k, w in want.items()}
        assert sorted(set(got) - set(want)) == [51, 52] and got[52][0].n == 2 and got[52][0].mean == 2.0
        for k in want:
            x, y = data(k)
            for r in got[k]:
                a, b = (r["first"] - 10) // 2, (r["last"] - 10) // 2 + 1
                assert r.n == b - a and r.mean == pytest.approx(y[a:b].mean())
                if joint:
                    assert r.slope == pytest.approx(np.polyfit(x[a:b], y[a:b], 1)[0])
    assert got[51][0].slope is None and got[52][0].slope is None
    assert any(len(w[0]) > len(w[1]) > 1 for w in want.values())


def test_states_against_the_definition(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in range(5) for i, v in enumerate(np.r_[rng.normal(0, 1, 20 + k), rng.normal(6, 1, 15)])]
    df = spark.createDataFrame(rows, "bid int, frame long, x double")
    got = models.hidden_states(df, "x", keys=("bid",)).collect()
    for k in range(5):
        x = np.array([r[2] for r in rows if r[0] == k])
        mine = [r.state for r in sorted((r for r in got if r.bid == k), key=lambda r: r.frame)]
        assert mine == models.fit_states(x).tolist() and mine == [0] * (20 + k) + [1] * 15


def test_chances_of_a_short_series_by_enumeration():
    """Forward and backward sums against all paths of states."""
    rng = np.random.default_rng(1)
    p, change, start = rng.random((5, 2)), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([0.6, 0.4])
    g, moves = models.forward_backward(p, change, start)
    weight, want, want_moves = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for path in np.ndindex(*[2] * 5):
        w = start[path[0]] * p[0, path[0]] * math.prod(change[a, b] * p[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))
        weight += w
        for t, s in enumerate(path):
            want[t, s] += w
        for a, b in zip(path, path[1:]):
            want_moves[a, b] += w
    assert np.allclose(g, want / weight) and np.allclose(moves, want_moves / weight)
