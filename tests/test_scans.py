"""Image scans, enclosures, orientation and graph repairs against plain loops."""

import math
import random

import numpy as np
import pytest

from trackloom.operators import enclosure, graph, images, orientation
from trackloom.operators.tracks import life_steps, taped


def objects_of(pixels):
    todo, out = set(pixels), []
    while todo:
        first = min(todo)
        stack, found = [first], set()
        todo.discard(first)
        while stack:
            x, y = stack.pop()
            found.add((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in todo:
                    todo.discard(q)
                    stack.append(q)
        out.append(found)
    return out


@pytest.mark.parametrize("tile", [1, 5, 64])
def test_objects_in_tiles(spark, tile):
    rng = np.random.default_rng(0)
    pictures = {k: {(int(x) - 9, int(y) - 4) for x, y in np.argwhere(rng.random((23, 31)) < p)} for k, p in enumerate((0.3, 0.55, 0.65, 0.95))}
    rows = [(f"p{k}", x, y) for k, m in pictures.items() for x, y in m]
    rows += rows[:50] + [("p0", None, 1), ("alone", 3, 3)]
    got = images.tiled_components(spark.createDataFrame(rows, "image string, x int, y int"), "image", tile).collect()
    want = {("alone", 3, 3, 1, 3, 3, 3, 3)}
    for k, m in pictures.items():
        for o in objects_of(m):
            xs, ys = [p[0] for p in o], [p[1] for p in o]
            want.add((f"p{k}", *min(o), len(o), min(xs), max(xs), min(ys), max(ys)))
            at = next(r for r in got if (r.image, r.x0, r.y0) == (f"p{k}", *min(o)))
            assert (at.x, at.y) == pytest.approx((np.mean(xs), np.mean(ys)))
    assert {tuple(r)[:8] for r in got} == want and len(got) == len(want)


def test_matches_of_a_scan(spark):
    rng, objects, tracked, want = random.Random(3), [], [], {}
    for image in range(6):
        os = [(rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(rng.randint(0, 12))]
        bs = [(rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(rng.randint(1, 15))]
        objects += [(image, x, y) for x, y in os]
        tracked += [(image, b, x, y) for b, (x, y) in enumerate(bs)]
        taken = [min((math.hypot(x - p, y - q), p, q) for p, q in os)[1:] for x, y in bs if any(math.hypot(x - p, y - q) <= 4 for p, q in os)]
        want[image] = (len(taken), len(os) - len(set(taken)), len(bs) - len(taken), sum(taken.count(t) > 1 for t in set(taken)))
    found = images.scan_matches(spark.createDataFrame(objects, "image int, x double, y double"), spark.createDataFrame(tracked, "image int, bid int, x double, y double"), "image", 4.0)
    assert {r.image: tuple(r)[1:] for r in found.collect()} == want


def plain_walls(v, kernel, reach, step):
    dark = v < v.mean()
    w, h = v.shape
    half = kernel // 2
    fits = np.zeros_like(dark)
    for x in range(w):
        for y in range(h):
            a, b = x - half, y - half
            fits[x, y] = a >= 0 and b >= 0 and a + kernel <= w and b + kernel <= h and dark[a : a + kernel, b : b + kernel].all()
    dark = np.zeros_like(fits)
    for x, y in np.argwhere(fits):
        dark[x - half : x - half + kernel, y - half : y - half + kernel] = True
    cx, cy, out = w // 2, h // 2, set()
    for i in range(-reach, reach, step):
        if 0 <= cy + i < h:
            out.add(("left", max([x for x in range(cx + 1) if dark[x, cy + i]], default=0), cy + i))
            out.add(("right", min([x for x in range(cx, w) if dark[x, cy + i]], default=w - 1), cy + i))
        if 0 <= cx + i < w:
            out.add(("top", cx + i, max([y for y in range(cy + 1) if dark[cx + i, y]], default=0)))
            out.add(("bottom", cx + i, min([y for y in range(cy, h) if dark[cx + i, y]], default=h - 1)))
    return out


def test_enclosures(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for k in range(4):
        v = 200 + rng.integers(0, 20, (44, 36))
        v[: 6 + k], v[38 - k :], v[:, :5], v[:, 30:] = 20, 20, 30, 30
        for x in range(44 if k > 1 else 0):
            v[x, : 5 + x // 9] = 10
        v[rng.random(v.shape) < 0.02] = 0
        rows += [(k, x, y, int(c)) for (x, y), c in np.ndenumerate(v)]
        want[k] = plain_walls(v, 4, 9, 3)
    df = spark.createDataFrame(rows, "image int, x int, y int, value long")
    points = enclosure.wall_points(df, 4, 9, 3)
    got = {}
    for r in points.collect():
        got.setdefault(r.image, set()).add((r.side, int(r.x), int(r.y)))
    assert got == want
    lines = {(r.image, r.side): r for r in enclosure.wall_lines(points).collect()}
    box = enclosure.enclosures(enclosure.wall_lines(points))
    found = {r.image: r for r in enclosure.longest_middle(box.withColumn("polygon", enclosure.polygon(1.0, 2.0))).collect()}
    for k, walls in want.items():
        fit = {}
        for side in enclosure.SIDES:
            xs, ys = (np.array([p[c] for p in walls if p[0] == side], dtype=float) for c in (1, 2))
            fit[side] = (None, xs[0]) if len(set(xs)) == 1 else tuple(np.polyfit(xs, ys, 1))
            mine = lines[k, side]
            assert (mine.m is None) == (fit[side][0] is None) and mine.b == pytest.approx(fit[side][1])
        r = found[k]
        for name, (p, q) in enclosure.CORNERS.items():
            (m1, b1), (m2, b2) = fit[p], fit[q]
            x = b1 if m1 is None else (b2 - b1) / (m1 - m2)
            assert tuple(r[name]) == pytest.approx((x, m2 * x + b2))
        length = lambda a, b: math.hypot(r[a].x - r[b].x, r[a].y - r[b].y)  # noqa: B023, E731
        assert r.aspect == pytest.approx((length("tl", "tr") + length("bl", "br")) / (length("tl", "bl") + length("tr", "br")))
        assert r.span == pytest.approx(max(r.h, r.v)) and len(r.polygon) == 8
    level = {c: {"x": float(x), "y": float(y)} for c, (x, y) in {"tl": (0, 0), "tr": (0, 20), "bl": (30, 0), "br": (30, 20)}.items()}
    plate = spark.createDataFrame([tuple(level.values())], ", ".join(f"{c} struct<x:double,y:double>" for c in level)).select(enclosure.polygon(1.0, 2.0).alias("p")).first().p
    assert [tuple(p) for p in plate] == [(2, 1), (1, 2), (1, 18), (2, 19), (28, 19), (29, 18), (29, 2), (28, 1)] or all(1 <= p.x <= 29 and 1 <= p.y <= 19 for p in plate)


def test_orientation_against_numpy(spark):
    rng, rows, want = np.random.default_rng(7), [], {}
    for bid in range(3):
        t = np.cumsum(np.where(rng.random(90) < 0.03, 9.0, rng.uniform(0.1, 0.4, 90)))
        angle, width, length = np.mod(np.cumsum(rng.normal(0, 0.4, 90)) + np.pi, 2 * np.pi) - np.pi, rng.uniform(1, 4, 90), rng.uniform(5, 8, 90)
        rows += [(bid, i, float(t[i]), float(angle[i]), float(width[i]), float(length[i])) for i in range(90)]
        cuts = [0, *(np.flatnonzero(np.diff(t) >= 5) + 1), 90]
        for seg, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b - a < 11:
                continue
            wrap = lambda v: np.mod(v + np.pi, 2 * np.pi) - np.pi
            change = wrap(np.diff(angle[a:b], prepend=0))
            mean = lambda v: np.pad(np.convolve(v, np.ones(11) / 11, "valid"), 5, "edge")
            cols = mean(width[a:b]) / mean(length[a:b]), np.cumsum(change), mean(change)
            ticks = np.arange(math.ceil(t[a] / 0.2), math.ceil(t[b - 1] / 0.2))
            if (ticks[-1] - ticks[0]) * 0.2 < 5:
                continue
            ar, orr, ch = (np.interp(ticks * 0.2, t[a:b], c) for c in cols)

            def runs(hit):
                out, i = np.zeros(len(hit), dtype=int), 0
                while i < len(hit):
                    j = i
                    while j < len(hit) and hit[j] == hit[i]:
                        j += 1
                    out[i:j], i = (j - i) * hit[i], j
                return out

            for row in zip(ticks, ar, orr, ch, runs(ar > 0.4) > 10, runs(np.abs(ch) > 0.01) > 1):
                want[bid, seg, int(row[0])] = row[1:]
    df = spark.createDataFrame(rows, "bid int, frame int, time double, angle double, w double, l double")
    got = {(r.bid, r.segment, r.tick): (r.ar, r.orientation, r.change, r.is_coil, r.is_reorienting) for r in orientation.orientations(df, "angle", "w", "l").collect()}
    assert set(got) == set(want) and len(want) > 100
    for k, v in got.items():
        assert v[:3] == pytest.approx(want[k][:3]) and v[3:] == tuple(map(bool, want[k][3:]))


# --- graphs: nodes as {id: (born, died)}, edges as pairs


def graph_of(spark, lives, edges):
    nodes = spark.createDataFrame([(n, a, b, a / 10, b / 10) for n, (a, b) in lives.items()], "node_id long, born_f long, died_f long, born_t double, died_t double")
    return graph.make_graph(nodes, spark.createDataFrame(sorted(edges), "src long, dst long"))


def plain_assimilate(lives, edges, longest):
    lives, edges = {n: (a, b, {n}) for n, (a, b) in lives.items()}, set(edges)
    for near, away in ((1, 0), (0, 1)):
        while True:
            joins = {}
            for n, (a, b, _) in lives.items():
                others = {e[away] for e in edges if e[near] == n}
                if b - a + 1 <= longest and len(others) == 1:
                    joins[n] = others.pop()
            if not joins:
                break

            def head(n):
                return head(joins[n]) if n in joins else n  # noqa: B023

            merged = {}
            for n, (a, b, parts) in lives.items():
                p, q, r = merged.get(head(n), (a, b, set()))
                merged[head(n)] = min(a, p), max(b, q), parts | r
            edges = {(head(a), head(b)) for a, b in edges if head(a) != head(b)}
            lives = merged
    return {n: (a, b, sorted(p)) for n, (a, b, p) in lives.items()}, edges


def as_plain(found):
    nodes, edges = found
    return {r.node_id: (r.born_f, r.died_f, r.components) for r in nodes.collect()}, {(r.src, r.dst) for r in edges.collect()}


def test_short_neighbours_are_taken_in(spark):
    three = {10: (0, 9), 20: (10, 11), 21: (10, 11), 22: (10, 11), 30: (12, 21)}
    ways = {(10, x) for x in (20, 21, 22)} | {(x, 30) for x in (20, 21, 22)}
    assert as_plain(graph.assimilate(graph_of(spark, three, ways), 2)) == ({10: (0, 11, [10, 20, 21, 22]), 30: (12, 21, [30])}, {(10, 30)})
    assert as_plain(graph.assimilate(graph_of(spark, three, ways), 1.9))[1] == ways
    cross = {10: (0, 9), 11: (0, 9), 20: (10, 10), 30: (11, 20), 31: (11, 20)}
    through = {(10, 20), (11, 20), (20, 30), (20, 31)}
    assert as_plain(graph.assimilate(graph_of(spark, cross, through), 6))[1] == through
    for seed in range(3):
        rng = random.Random(seed)
        lives = {n: (10 * n, 10 * n + rng.choice((0, 2, 5, 30))) for n in range(30)}
        edges = {(a, b) for a in range(30) for b in range(a + 1, min(30, a + 5)) if rng.random() < 0.35}
        assert as_plain(graph.assimilate(graph_of(spark, lives, edges), 6)) == plain_assimilate(lives, edges, 6)


def test_relinked_taped_and_steps(spark):
    lives = {n: (0, 9) for n in range(1, 6)}
    start = graph_of(spark, lives, {(1, 3), (2, 3), (3, 4), (3, 5)})
    nodes, edges = graph.relinked(start, spark.createDataFrame([(3, 1, 5), (3, 2, 4)], "collision long, parent long, child long"))
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 5), (2, 4)}
    assert {r.node_id: r.collisions for r in nodes.collect()} == {1: [3], 2: [3], 4: [], 5: []}
    rows = spark.createDataFrame([(1, 5.0, 9.0, 10, 30.0, 2.0), (2, 0.0, 4.0, 7, 10.0, 0.5), (3, 100.0, 160.0, 2, 20.0, 1.0)], "node_id long, t0 double, tN double, n long, area_median double, bl double")
    found = taped(rows, spark.createDataFrame([(1, 2)], "old long, new long")).collect()
    assert {r.node_id: tuple(r)[1:] for r in found} == {2: ([2, 1], 0.0, 9.0, 9.0, 17, 20.0), 3: ([3], 100.0, 160.0, 60.0, 2, 20.0)}
    steps = {r.node_id: (r.lifespan, r.mid) for r in life_steps(rows, "bl").collect()}
    assert steps == {1: pytest.approx((4 / 60, 7 / 60)), 3: pytest.approx((1.0, 130 / 60))}
