"""Masks, spines and curves against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import curves, models, spines, unzip
from trackloom.operators.images import RING, fill_points

# --- masks and crossings ---------------------------------------------------------------------


def far(p, mask):
    return min((max(abs(p[0] - x), abs(p[1] - y)) for x, y in mask), default=unzip.FAR_AWAY)


def grid_of(mask, shape):
    g = np.zeros(shape, dtype=bool)
    for p in mask:
        g[p] = True
    return g


def plain_step(a, b, whole, shape):
    """The next masks of two bodies, pixel by pixel."""
    kept, gone = [a & whole, b & whole], [a - whole, b - whole]
    cells = [(i, j) for i in range(shape[0]) for j in range(shape[1])]
    away = [{p: min(far(p, k), unzip.FAR_AWAY) for p in cells} for k in kept]
    near = [{p: d if d <= unzip.FAR + 1 else unzip.FAR_AWAY for p, d in x.items()} for x in away]
    rest = whole - kept[0] - kept[1]
    own = [{p for p in rest if near[i][p] < unzip.NEAR and near[1 - i][p] > unzip.FAR} for i in (0, 1)]
    out = []
    for i in (0, 1):
        ends = unzip.ends_of(grid_of(kept[i], shape))
        if len(ends) >= 2:
            nearest = [min(range(len(ends)), key=lambda k: (math.hypot(p[0] - ends[k][0], p[1] - ends[k][1]), k)) for p in sorted(gone[i])]
            share = nearest.count(0) / len(nearest) if 0 in nearest or 1 in nearest else 0.5
            weight = {p: min(math.hypot(p[0] - ends[0][0], p[1] - ends[0][1]) * share, math.hypot(p[0] - ends[1][0], p[1] - ends[1][1]) * (1 - share)) for p in cells}
        else:
            weight = dict.fromkeys(cells, unzip.WITHOUT_ENDS)
        mask, n = kept[i] | own[i], len(gone[i]) - len(own[i])
        todo = sorted((near[i][p] / weight[p] if weight[p] > 0 else math.inf, p) for p in whole - mask if near[i][p] < unzip.REACH)
        while n > 0:
            for k, (_, (r, c)) in enumerate(todo[:n]):
                ring = [(r + y, c + x) in mask for y, x in RING]
                if any(ring[k] and ring[(k + 1) % 8] for k in range(8)):
                    mask, n = mask | {(r, c)}, n - 1
                    del todo[k]
                    break
            else:
                break
        out.append(mask)
    return out


def plain_walk(a, b, x, y, frames, shape, margin=10):
    steps = 0
    while True:
        straight, crossed = len(a & x) + len(b & y), len(a & y) + len(b & x)
        verdict = "straight" if straight > crossed + margin else "crossed" if crossed > straight + margin else "open"
        if verdict != "open" or steps == len(frames):
            return verdict, steps, straight, crossed
        a, b = plain_step(a, b, frames[steps], shape)
        steps += 1


def bar(x, y, w=6, h=2):
    return {(i, j) for i in range(x - w, x + w + 1) for j in range(y - h, y + h + 1)}


def crossing(seed):
    rng = random.Random(seed)
    n, way, up, deep = rng.randint(8, 13), rng.choice((-1, 1)), rng.randint(0, 3), rng.randint(7, 9)
    half = n // 2 + 1
    at = lambda t: (deep * min(t, half) // half, way * (14 * max(0, t - half) // (n + 1 - half)))
    a = lambda t: bar(at(t)[0] - 14, at(t)[1])
    b = lambda t: bar(14 - at(t)[0], up - at(t)[1], h=rng.choice((1, 2)) if seed % 5 == 0 else 2)
    children = [a(n + 1), b(n + 1)]
    truth = rng.choice(("straight", "crossed"))
    return a(0), b(0), *(children if truth == "straight" else children[::-1]), [a(t) | b(t) for t in range(1, n + 1)], truth


def rows_of(k, a, b, x, y, frames):
    points = lambda m: [{"x": i, "y": j} for i, j in sorted(m)]
    rows = [(k, "a", 0, points(a)), (k, "b", 0, points(b)), (k, "x", 99, points(x)), (k, "y", 99, points(y))]
    return rows + [(k, "c", t + 1, points(m)) for t, m in enumerate(frames)]


MASKS = "collision long, role string, frame int, points array<struct<x:int,y:int>>"


def test_crossings_resolve_as_a_plain_walk_does(spark):
    rows, want, right = [], {}, 0
    for k in range(24):
        *sets, frames, truth = crossing(k)
        rows += rows_of(k, *sets, frames)
        every = set().union(*sets, *frames)
        low = min(p[0] for p in every) - 1, min(p[1] for p in every) - 1
        shape = max(p[0] for p in every) - low[0] + 2, max(p[1] for p in every) - low[1] + 2
        move = lambda m: {(x - low[0], y - low[1]) for x, y in m}  # noqa: B023, E731
        want[k] = plain_walk(*map(move, sets), [move(f) for f in frames], shape)
        right += want[k][0] == truth
    rows += [(50, "a", 0, [{"x": 1, "y": 1}]), (50, "c", 1, None), *rows_of(51, bar(0, 0), bar(40, 0), bar(0, 0), bar(40, 0), [])]
    random.Random(1).shuffle(rows)
    got = {r.collision: (r.verdict, r.steps, r.straight, r.crossed) for r in unzip.unzipped(spark.createDataFrame(rows, MASKS)).collect()}
    assert got.pop(51) == ("straight", 0, 130, 0)
    assert got == want and right >= 16


def test_long_collisions_are_walked_in_steps(spark):
    *sets, frames, _ = crossing(3)
    rows = rows_of(1, *sets, [f for f in frames for _ in range(40)])
    got = unzip.unzipped(spark.createDataFrame(rows, MASKS), margin=10**6, most=10).first()
    n = 40 * len(frames)
    assert got.verdict == "open" and got.steps == len(range(0, n, n // 10))


def test_distances_pairs_and_aligned_outlines(spark):
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.1
        want = [[far((i, j), [tuple(p) for p in np.argwhere(m)]) for j in range(m.shape[1])] for i in range(m.shape[0])]
        assert unzip.distance_from(m).tolist() == want
        assert (unzip.distance_from(m, 3) == np.where(np.array(want) > 3, unzip.FAR_AWAY, want)).all()
    found = spark.createDataFrame([(1, "straight"), (2, "crossed"), (3, "open")], "collision int, verdict string")
    pairs = unzip.untangling(found, F.array(F.lit(10), F.lit(11)), F.array(F.lit(20), F.lit(21))).collect()
    assert sorted(map(tuple, pairs)) == [(1, 10, 20), (1, 11, 21), (2, 10, 21), (2, 11, 20)]
    shapes = spark.createDataFrame([(1, 1, [(5, 7), (6, 8)]), (1, 2, [(3, 9)]), (1, 3, None), (2, 1, [])], "bid int, frame int, o array<struct<x:int,y:int>>")
    assert [r.frame for r in unzip.outlines_of(shapes, "o", "bid", first=False).collect()] == [2]
    got = {r.frame: r for r in unzip.aligned_outlines(unzip.outlines_of(shapes, "o", "bid"), "o", "bid").collect()}
    assert [tuple(p) for p in got[1].shifted] == [(3, 1), (4, 2)] and [tuple(p) for p in got[2].shifted] == [(1, 3)] and (got[1].width, got[1].height) == (6, 5)


# --- spines ----------------------------------------------------------------------------------


def all_pairs_longest(pixels):
    graph, best = spines.pixel_graph(pixels), 0
    for p in pixels:
        depth, todo = {p: 0}, [p]
        for q in todo:
            for r in graph[q]:
                if r not in depth:
                    depth[r] = depth[q] + 1
                    todo.append(r)
        best = max(best, *depth.values())
    return best


def random_tree(rng):
    pixels, tips = {(0, 0)}, [(0, 0)]
    for _ in range(rng.randint(1, 5)):
        x, y = rng.choice(sorted(pixels))
        dx, dy = rng.choice(((1, 0), (0, 1), (1, 1), (-1, 1)))
        for _ in range(rng.randint(2, 9)):
            x, y = x + dx, y + dy
            new = pixels | {(x, y)}
            g = spines.pixel_graph(new)
            if sum(map(len, g.values())) != 2 * (len(new) - 1):
                break
            pixels = new
    return pixels


def test_the_path_is_the_longest_of_a_tree():
    for seed in range(60):
        pixels = random_tree(random.Random(seed))
        path = spines.longest_path(pixels)
        graph = spines.pixel_graph(pixels)
        assert len(path) == all_pairs_longest(pixels) + 1 and path[0] <= path[-1] and len(set(path)) == len(path)
        assert all(q in graph[p] for p, q in zip(path, path[1:]))
    ring = {(x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)}
    assert spines.longest_path(ring) == [] and spines.longest_path(set()) == [] and spines.longest_path({(3, 3)}) == [(3, 3)]


def test_spines_of_outlines(spark):
    box = [(x, 0) for x in range(30)] + [(29, y) for y in range(1, 5)] + [(x, 4) for x in range(28, -1, -1)] + [(0, y) for y in range(3, 0, -1)]
    rows = [(1, box), (2, None), (3, []), (4, [(0, 0)])]
    df = spark.createDataFrame([(i, o and [{"x": x, "y": y} for x, y in o]) for i, o in rows], "id int, o array<struct<x:int,y:int>>")
    got = {r.id: [tuple(p) for p in r.s] for r in df.select("id", spines.spine_from_outline(F.col("o")).alias("s")).collect()}
    assert got[2] == got[3] == got[4] == []
    inside = set(fill_points([{"x": x, "y": y} for x, y in box]))
    assert len(got[1]) >= 24 and set(got[1]) <= inside and all(abs(y - 2) <= 1 for _, y in got[1][3:-3])


def plain_width(spine, outline, place):
    i = min(place, len(spine) - 2)
    (px, py), (qx, qy) = spine[i], spine[i + 1]
    dx, dy = (qx - px, qy - py) if (px, py) != (qx, qy) else (1e-6, 0)
    size = math.hypot(dx, dy)
    mx, my, u, v = (px + qx) / 2, (py + qy) / 2, dy / size, -dx / size
    found = set()
    for (ax, ay), (bx, by) in zip(outline, outline[1:] + outline[:1]):
        ex, ey = bx - ax, by - ay
        d = ey * u - ex * v
        if d:
            t = (ex * (my - ay) - ey * (mx - ax)) / d
            x, y = mx + t * u, my + t * v
            if min(ax, bx) - 0.5 <= x <= max(ax, bx) + 0.5 and min(ay, by) - 0.5 <= y <= max(ay, by) + 0.5:
                found.add(t)
    if len(found) < 2:
        return -1.0
    less, more = sorted((t for t in found if t < 0), reverse=True), sorted(t for t in found if t >= 0)
    return more[0] - less[0] if less and more else (more[1] - more[0] if more else less[0] - less[1])


def test_widths_against_a_plain_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    for k in range(40):
        spine = [(i, rng.randint(-2, 2)) for i in range(rng.randint(2, 12))]
        n = rng.randint(3, 30)
        outline = [(round(6 + 9 * math.cos(2 * math.pi * i / n)), round(5 * math.sin(2 * math.pi * i / n))) for i in range(n)]
        if k % 7 == 0:
            outline = [(x + 40, y) for x, y in outline]
        place = rng.randint(0, len(spine) - 1)
        rows.append((k, [{"x": x, "y": y} for x, y in spine], [{"x": x, "y": y} for x, y in outline], place))
        want[k] = plain_width(spine, outline, place)
    rows += [(90, [], [{"x": 1, "y": 1}], 0), (91, None, None, 0), (92, [{"x": 1, "y": 1}, {"x": 1, "y": 1}], rows[1][2], 0)]
    df = spark.createDataFrame(rows, "id int, s array<struct<x:int,y:int>>, o array<struct<x:int,y:int>>, place int")
    got = {r.id: r.w for r in df.select("id", spines.width_at(F.col("s"), F.col("o"), F.col("place")).alias("w")).collect()}
    assert got.pop(90) is None and got.pop(91) is None
    assert got.pop(92) == pytest.approx(plain_width([(1, 1), (1, 1)], [(p["x"], p["y"]) for p in rows[1][2]], 0))
    assert got == pytest.approx(want)


# --- curves ----------------------------------------------------------------------------------


def numpy_spaced(p, n):
    run = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    return np.stack([np.interp(np.linspace(0, run[-1], n), run, p[:, c]) for c in (0, 1)], axis=1)


def numpy_savgol(y, width, order):
    half = width // 2
    y = np.asarray(y, dtype=float)
    padded = np.r_[y[0] - np.abs(y[1 : half + 1][::-1] - y[0]), y, y[-1] + np.abs(y[-half - 1 : -1][::-1] - y[-1])]
    return np.convolve(models.savgol_weights(width, order)[::-1], padded, mode="valid")


def test_spacing_and_closed_smoothing(spark):
    rng = np.random.default_rng(1)
    shapes = {k: rng.normal(size=(rng.integers(2, 40), 2)).cumsum(axis=0) for k in range(8)}
    rows = [(k, i, float(x), float(y)) for k, p in shapes.items() for i, (x, y) in enumerate(p)] + [(20, i, 1.0, 1.0) for i in range(3)] + [(21, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "bid int, place int, x double, y double")
    for n in (None, 2, 17):
        got = {}
        for r in curves.spaced(df, n).orderBy("bid", "place").collect():
            got.setdefault(r.bid, []).append((r.place, r.x, r.y))
        assert sorted(got) == sorted(shapes)
        for k, p in shapes.items():
            want = numpy_spaced(p, n or len(p))
            assert [g[0] for g in got[k]] == list(range(len(want))) and np.allclose([g[1:] for g in got[k]], want)
    got = {}
    for r in curves.smoothed_around(df.where("bid < 20"), 23, 3).orderBy("bid", "place").collect():
        got.setdefault(r.bid, []).append((r.x, r.y))
    for k, p in shapes.items():
        if len(p) >= 12:
            around = np.r_[p[-3:], p, p[:3]]
            want = np.stack([numpy_savgol(around[:, c], 23, 3) for c in (0, 1)], axis=1)[3:-2]
            assert np.allclose(got[k], want)


def test_smoothing_in_time_against_matrices(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(0.5, 1.5, 30))
    mats = np.stack([np.linspace(0, 10, 12)[None, :] + t[:, None] + 0.2 * rng.normal(size=(30, 12)), np.sin(np.linspace(0, 3, 12))[None, :] * 3 + 0.2 * rng.normal(size=(30, 12))])
    rows = [(1, float(t[i]), j, float(mats[0, i, j]), float(mats[1, i, j])) for i in range(30) for j in range(12)]

    def once(m):
        m = np.stack([np.stack([numpy_savgol(m[c][:, j], 9, 3) for j in range(12)], axis=1) for c in (0, 1)])
        m = np.stack([np.stack([numpy_savgol(m[c][i], 5, 2) for i in range(m.shape[1])]) for c in (0, 1)])
        return np.stack([numpy_spaced(m[:, i].T, 12).T for i in range(m.shape[1])], axis=1)

    m = once(mats)
    ticks = np.arange(math.ceil(t[0]), math.ceil(t[-1]))
    m = np.stack([np.stack([np.interp(ticks, t, m[c][:, j]) for j in range(12)], axis=1) for c in (0, 1)])
    for _ in range(2):
        m = once(m)
    got = curves.smoothed_in_time(spark.createDataFrame(rows, "bid int, time double, place int, x double, y double"), (5, 2), (9, 3), 1.0, 2).collect()
    assert len(got) == m[0].size
    for r in got:
        assert (r.x, r.y) == pytest.approx((m[0, r.tick - ticks[0], r.place], m[1, r.tick - ticks[0], r.place]))


def test_directions_against_a_fold(spark):
    rng, rows, want = random.Random(9), [], {}
    point = lambda: {"x": rng.randint(0, 4), "y": rng.randint(0, 4)}
    for bid in range(20):
        before = None
        for frame in range(30):
            a, b = (None, None) if rng.random() < 0.1 else (point(), point())
            rows.append((bid, frame, a, b))
            away = lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2
            turned = bool(a and before and away(before, a) > away(before, b))
            want[bid, frame] = turned
            before = (b if turned else a) if a else None
    df = spark.createDataFrame(rows, "bid int, frame int, a struct<x:int,y:int>, b struct<x:int,y:int>")
    got = {(r.bid, r.frame): r.turned for r in curves.kept_direction(df, F.col("a"), F.col("b")).collect()}
    assert got == want


def test_steps_in_space_against_a_loop(spark):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for bid in range(6):
        p = rng.normal(size=(rng.integers(1, 30), 2)).cumsum(axis=0)
        rows += [(bid, 5 * i, float(x), float(y)) for i, (x, y) in enumerate(p)]
        dense = [(i + k / 50, p[i] + k / 50 * (p[i + 1] - p[i])) for i in range(len(p) - 1) for k in range(50)]
        kept = []
        for at, q in dense:
            if not kept or np.hypot(*(q - kept[-1][1])) >= 0.7:
                kept.append((at, q))
        want += [(bid, n, at, *q) for n, (at, q) in enumerate(kept)]
    got = curves.stepped(spark.createDataFrame(rows, "bid int, place int, x double, y double"), 0.7).collect()
    got = sorted((r.bid, r.place, r.at, r.x, r.y) for r in got)
    assert len(got) == len(want) and np.allclose(got, want)


def test_crossings_that_are_laid_are_walked_alike_and_not_shuffled(spark):
    """Masks that come from one row of a task stay there; the same masks elsewhere, and a group over many batches, have the same outcome."""
    rows = []
    for k in range(6):
        *sets, frames, _ = crossing(k)
        for copy in range(3):
            rows += [(10 * k + copy, role, t, [{"x": p["x"] + 100 * copy, "y": p["y"] - copy} for p in points]) for _, role, t, points in rows_of(k, *sets, frames)]
    masks = spark.createDataFrame(rows, MASKS)
    want = sorted(map(tuple, unzip.unzipped(masks).collect()))
    assert [r[1:] for r in want[::3]] == [r[1:] for r in want[1::3]] == [r[1:] for r in want[2::3]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = unzip.unzipped(masks.coalesce(1), laid=True)
        assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Repartition" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Repartition 1, false", "")
