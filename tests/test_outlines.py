import random

from trackloom.operators import curves
from trackloom.plans import shape_queries, stat_queries


def test_extents_of_codes(spark):
    rng, rows, want = random.Random(4), [], set()
    for k in range(8):
        code = "".join(chr(48 + rng.randrange(64)) for _ in range(rng.randrange(0, 40)))
        n = rng.randrange(0, 3 * len(code) + 5)
        x, y = rng.randrange(-5, 5), rng.randrange(-5, 5)
        rows.append((k, x, y, n, code))
        at = [(x, y)]
        for s in [(ord(c) - 48) >> s & 3 for c in code for s in (4, 2, 0)][:n]:
            x, y = x + {0: -1, 1: 1}.get(s, 0), y + {2: -1, 3: 1}.get(s, 0)
            at.append((x, y))
        xs, ys = zip(*at)
        want.add((k, len(at) - 1, x, y, min(xs), max(xs), min(ys), max(ys)))
    rows += [(20, None, 1, 3, "0"), (21, 1, 1, 3, None)]
    got = curves.outline_extents(spark.createDataFrame(rows, "k int, x int, y int, n int, code string"), "k").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, "0")], "k int, x int, y int, n int, code string")
    assert "Exchange" not in plan(curves.outline_points(rows, "k"))
    assert plan(shape_queries.outline_points(spark, "/root/testdata/sf0.001")).count("Exchange hashpartitioning") == 1
    assert "aggregate(" not in plan(stat_queries.outline_decode(spark, "/root/testdata/sf0.001"))
