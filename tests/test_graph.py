import random

import pytest

from trackloom.operators import graph as g
from trackloom.operators.components import connected_components


def build(spark, *paths, life=10):
    nodes = sorted({n for p in paths for n in p})
    level = {}
    for p in paths:
        for i, n in enumerate(p):
            level[n] = max(level.get(n, 0), i)
    life = life if callable(life) else (lambda n, k=life: k)
    rows = [(n, 100 * level[n], 100 * level[n] + life(n) - 1, 10.0 * level[n], 10.0 * level[n] + life(n) / 10 - 0.1) for n in nodes]
    edges = sorted({(a, b) for p in paths for a, b in zip(p, p[1:])})
    return g.make_graph(spark.createDataFrame(rows, "node_id long, born_f long, died_f long, born_t double, died_t double"), spark.createDataFrame(edges, "src long, dst long"))


def edges(graph):
    return sorted((r.src, r.dst) for r in graph[1].collect())


def components(graph, node):
    return graph[0].where(f"node_id = {node}").first().components


def test_condense_merges_tags(spark):
    graph = build(spark, [1, 3, 4, 6, 7], [2, 3, 5, 6, 8])
    out = g.condense(graph, spark.createDataFrame([(4, 3), (5, 3), (6, 3)], "old long, new long"))
    tags = {(r.src, r.dst): [(t.a, t.b) for t in r.tags] for r in out[1].collect()}
    assert tags == {(1, 3): [(1, 3)], (2, 3): [(2, 3)], (3, 7): [(6, 7)], (3, 8): [(6, 8)]}
    out = g.condense(graph, spark.createDataFrame([(4, 3), (5, 3)], "old long, new long"))
    tags = {(r.src, r.dst): [(t.a, t.b) for t in r.tags] for r in out[1].collect()}
    assert tags[(3, 6)] == [(4, 6), (5, 6)]


def test_chains(spark):
    assert edges(g.contract_chains(build(spark, [10, 20, 30, 40], [11, 20], [30, 41]))) == [(10, 20), (11, 20), (20, 40), (20, 41)]
    assert len(edges(g.contract_chains(build(spark, [10, 20, 30, 40], [11, 20, 31, 40])))) == 6


def test_split_joins(spark):
    out = g.remove_split_joins(build(spark, [10, 20, 30, 40, 50], [11, 20, 31, 40, 51]), max_frames=50)
    assert edges(out) == [(10, 20), (11, 20), (20, 50), (20, 51)]
    assert components(out, 20) == [20, 30, 31, 40]
    out = g.remove_split_joins(build(spark, [10, 20, 30, 40, 50, 60, 70], [11, 20, 31, 40, 51, 60, 71]))
    assert edges(out) == [(10, 20), (11, 20), (20, 70), (20, 71)]
    assert components(out, 20) == [20, 30, 31, 40, 50, 51, 60]
    same = build(spark, [10, 20, 30, 40, 50], [11, 20, 29], [31, 40, 51])
    assert edges(g.remove_split_joins(same)) == edges(same)
    assert edges(g.remove_split_joins(build(spark, [10, 20, 30, 40], [20, 31, 40], life=90), max_frames=50)) == [(10, 20), (20, 30), (20, 31), (30, 40), (31, 40)]


def test_offshoots(spark):
    graph = build(spark, [10, 20, 30, 40, 50], [11, 20, 31], [30, 41, 50])
    out = g.remove_offshoots(graph, 10)
    assert 31 not in {r.node_id for r in out[0].collect()} and components(out, 20) == [20, 31]
    assert out[0].where("node_id = 20").first().died_f == graph[0].where("node_id = 20").first().died_f
    assert edges(g.remove_offshoots(graph, 9)) == edges(graph)


def test_untangle_and_bridge(spark):
    graph = build(spark, [1, 3, 4, 6, 7], [2, 3, 5, 6, 8])
    out = g.untangle(graph, spark.createDataFrame([(3, 1, 4), (3, 2, 5)], "collision long, parent long, child long"))
    assert edges(out) == [(1, 6), (2, 6), (6, 7), (6, 8)]
    out = g.bridge_gaps(build(spark, [1, 2], [3, 4]), spark.createDataFrame([(2, 3)], "node1 long, node2 long"))
    assert edges(out) == [(1, 2), (2, 4)]
    assert [(t.a, t.b) for t in out[1].where("src = 2").first().tags] == [(3, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_matching(spark, seed):
    r = random.Random(seed)
    pairs = list({(r.randrange(30), 100 + r.randrange(30)): r.randrange(15) for _ in range(150)}.items())
    rows = [(a, b, float(s)) for (a, b), s in pairs]
    want, used = set(), set()
    for a, b, s in sorted(rows, key=lambda x: (x[2], x[0], x[1])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    got = g.greedy_matching(spark.createDataFrame(rows, "node1 long, node2 long, score double"))
    assert {(x.node1, x.node2) for x in got.collect()} == want


def test_components(spark):
    r = random.Random(5)
    rows = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in rows if e[0] != e[1] for x in e}


def test_object_counts(spark):
    graph = build(spark, [1, 3, 4], [2, 3, 5])
    areas = spark.createDataFrame([(i, 10.0) for i in range(1, 6)], "node_id long, area double")
    movers = spark.createDataFrame([(1,), (2,)], "node_id long")
    got = {r.node_id: r["count"] for r in g.object_counts(graph, areas, movers).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: 1.0, 5: 1.0}


def test_empty(spark):
    graph = build(spark, [1, 2])
    none = (graph[0].limit(0), graph[1].limit(0))
    assert g.contract_chains(none)[0].count() == 0
    assert g.remove_split_joins(none)[1].count() == 0


PAIRS = "collision long, parent long, child long"


def test_collisions_are_dissolved_inside_solve(spark):
    graph = build(spark, [1, 3, 4], [2, 3, 5], [4, 6, 7], [5, 6, 8], life=lambda n: 50)
    pairs = spark.createDataFrame([(3, 1, 5), (3, 2, 4), (6, 4, 7), (6, 5, 8), (9, 1, 2), (3, 77, 4)], PAIRS)
    out = g.solve(graph, 5, 0.25, 1, collisions=pairs)
    assert {r.node_id: r.components for r in out[0].collect()} == {1: [1, 5, 8], 2: [2, 4, 7]} and edges(out) == []
    assert components(g.solve(graph, 5, 0.25, 1), 1) == [1]


def test_collisions_side_by_side_and_half_known_ones(spark):
    graph = build(spark, [1, 3, 4, 5], [2, 3, 9], [8, 4, 6], life=lambda n: 50)
    pairs = spark.createDataFrame([(3, 1, 4), (3, 2, 9), (4, 3, 5), (4, 8, 6)], PAIRS)
    first = g.resolved_collisions(graph, pairs).collect()
    assert sorted(tuple(r) for r in first) == [(3, 1, 4), (3, 2, 9)]
    out = g.untangle_all(graph, pairs)
    assert sorted(r.node_id for r in out[0].collect()) == [1, 2, 5, 6, 8] and edges(out) == [(1, 5), (1, 6), (8, 1)]
    half = spark.createDataFrame([(3, 1, 4), (4, 3, 5), (4, 3, 6)], PAIRS)
    assert edges(g.untangle_all(graph, half)) == edges(graph)
    assert g.resolved_collisions(graph, spark.createDataFrame([], PAIRS)).collect() == []


def test_loose_graphs_are_solved_alike(spark, monkeypatch):
    """only edges that may be followed are rows, and chains, splits and offshoots come out as with all edges."""
    from trackloom.operators import loose

    r = random.Random(11)
    rows = []
    for k in range(260):
        t0 = r.randrange(4000) / 4 if k < 200 else 2000 + r.randrange(200) / 8
        rows.append((k, 10 * k, 10 * k + r.choice((0, 0, 3, 40)), t0, t0 + r.choice((0.0, 0.5, 3.0, 30.0)), r.choice("abc"), r.choice("abc")))
    tracks = spark.createDataFrame(rows, "node_id long, born_f long, died_f long, born_t double, died_t double, first_kind string, last_kind string").selectExpr("*", "born_t AS first_at", "died_t AS last_at", "array(node_id) AS components")
    every = [(a[0], b[0]) for a in rows for b in rows if a[6] == b[5] and 0 < b[3] - a[4] <= 12]
    whole = g.make_graph(tracks.drop(*g.LOOSE), spark.createDataFrame(every, "src long, dst long"))
    sparse = loose.loose_graph(tracks, 12)
    assert sparse[1].count() < 0.7 * len(every) and g.n_nodes_and_edges(sparse) == (260, len(every))
    flat = lambda graph: sorted((x.node_id, x.components, x.born_f, x.died_f, x.n_in, x.n_out) for x in g.with_degrees(*graph).collect())
    assert flat(sparse) == flat(whole)
    solved = g.simplify(whole, 5, 0.25, 1)
    assert flat(g.simplify(sparse, 5, 0.25, 1)) == flat(solved) and solved[0].count() < 250
