import random

from trackloom.operators import reach
from trackloom.plans import graph_queries


def random_line(n, keys, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = rng.randrange(60) / 2
        out.append((i, rng.choice(keys), at, rng.choice(keys), at + rng.choice((0, 0, 1, 5)), i % 3 == 0))
    return out


def test_all_that_can_be_reached(spark, monkeypatch):
    monkeypatch.setattr(reach, "TOGETHER", 4)  # several groups
    line = random_line(80, "abc", 5) + [(900, None, 3.0, "a", 3.0, True), (901, "a", 4.0, None, 4.0, True)]
    follows = {i: [j for j, key, at, *_ in line if key is not None and key == key2 and 0 < at - at2 <= 2] for i, _, _, key2, at2, _ in line}
    want = set()
    for start in (r[0] for r in line if r[5]):
        todo = [start]
        while todo:
            now = todo.pop()
            if (start, now) not in want:
                want.add((start, now))
                todo += follows[now]
    got = [tuple(r) for r in reach.reachable(spark.createDataFrame(line, "id long, key string, at double, key2 string, at2 double, start boolean"), 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    none = spark.createDataFrame([r[:5] + (False,) for r in line], "id long, key string, at double, key2 string, at2 double, start boolean")
    assert reach.reachable(none, 2.0).collect() == []


def test_family_tree_makes_no_edges(spark, monkeypatch):
    def edges(*_, **__):
        raise AssertionError("edges are made")

    monkeypatch.setattr(graph_queries, "track_edges", edges)
    assert graph_queries.family_tree(spark, "/root/testdata/sf0.001").columns == ["start", "node_id"]


def test_a_few_steps(spark, monkeypatch):
    """F8: starts and what a few steps forth and back lead to, with several groups of starts."""
    monkeypatch.setattr(reach, "BITS", 5)
    line = [(*r[:5], r[0] % 2 == 0) for r in random_line(90, "abc", 7)] + [(900, None, 3.0, "a", 3.0, True), (901, "a", 4.0, None, 4.0, True)]
    beside = {i: set() for i, *_ in line}
    for i, _, _, key2, at2, _ in line:
        for j, key, at, *_ in line:
            if key is not None and key == key2 and 0 < at - at2 <= 2:
                beside[i].add(j)
                beside[j].add(i)
    want = {}
    for start in (r[0] for r in line if r[5]):
        front = {start}
        for k in range(4):
            want |= {(start, i): k for i in front if (start, i) not in want}
            front = {j for i in front for j in beside[i]}
    got = [tuple(r) for r in reach.within_steps(spark.createDataFrame(line, "id long, key string, at double, key2 string, at2 double, start boolean"), 2.0, 3).collect()]
    assert len(got) == len(want) and {(s, i): d for s, i, d in got} == want


def test_k_hop_makes_no_edges(spark, monkeypatch):
    """F8"""

    def edges(*_, **__):
        raise AssertionError("edges are made")

    monkeypatch.setattr(graph_queries, "track_edges", edges)
    assert graph_queries.k_hop(spark, "/root/testdata/sf0.001").columns == ["start", "node_id", "distance"]
