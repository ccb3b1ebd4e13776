"""Distances of samples, as columns and as rows, and points of outline codes."""

import random

import pytest

from trackloom.operators import curves, stats


def plain_ks(a, b):
    at = sorted(set(a + b))
    return max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in at)


@pytest.mark.parametrize("most", [24, 2])
def test_all_pairs_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MOST_COLUMNS", most)
    rng = random.Random(1)
    data = {n: [rng.gauss(k, 2) // 0.5 for _ in range(20 + 9 * k)] for k, n in enumerate("abcd")}
    rows = [(n, v) for n, vs in data.items() for v in vs] + [("a", None)]
    got = {(r.one, r.two): r.ks for r in stats.ks_all_pairs(spark.createDataFrame(rows, "s string, v double"), "v", "s", 1.0).collect()}
    assert got == pytest.approx({(a, b): plain_ks(data[a], data[b]) for a in data for b in data if a < b})


def test_one_sample_or_none_has_no_pairs(spark):
    for rows in ([], [("a", 1.0)]):
        assert stats.ks_all_pairs(spark.createDataFrame(rows, "s string, v double"), "v", "s", 1.0).collect() == []


def test_points_of_codes(spark):
    rng, rows, want = random.Random(2), [], set()
    for k in range(8):
        code = "".join(chr(48 + rng.randrange(64)) for _ in range(rng.randrange(0, 40)))
        n = rng.randrange(0, 3 * len(code) + 5)
        x, y = rng.randrange(-5, 5), rng.randrange(-5, 5)
        rows.append((k, x, y, n, code))
        want.add((k, 0, x, y))
        steps = [(ord(c) - 48) >> s & 3 for c in code for s in (4, 2, 0)][:n]
        for i, s in enumerate(steps):
            x, y = x + {0: -1, 1: 1}.get(s, 0), y + {2: -1, 3: 1}.get(s, 0)
            want.add((k, i + 1, x, y))
    rows += [(20, None, 1, 3, "0"), (21, 1, 1, 3, None)]
    got = curves.outline_points(spark.createDataFrame(rows, "k int, x int, y int, n int, code string"), "k").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
