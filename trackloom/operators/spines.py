"""Centre lines of outlines: skeleton to path, treated spines, widths across and speed along them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import displacement_along
from trackloom.operators.curves import kept_direction, smooth_line, spaced_line
from trackloom.operators.images import fill_points, thin
from trackloom.operators.models import savgol_weights

POINTS = "array<struct<x:int,y:int>>"


def pixel_graph(pixels: set[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The neighbours of each pixel: those beside it, and diagonal ones that no pixel beside both joins already."""
    out = {}
    for x, y in pixels:
        near = [q for q in ((x - 1, y), (x, y - 1), (x, y + 1), (x + 1, y)) if q in pixels]
        near += [(x + i, y + j) for i in (-1, 1) for j in (-1, 1) if (x + i, y + j) in pixels and (x + i, y) not in pixels and (x, y + j) not in pixels]
        out[x, y] = near
    return out


def sweep(graph: dict, start: tuple[int, int]) -> tuple[tuple[int, int], dict]:
    """(the farthest pixel from ``start``, the smallest of equally far ones; each pixel's predecessor)."""
    before, depth, todo = {start: None}, {start: 0}, deque([start])
    while todo:
        p = todo.popleft()
        for q in graph[p]:
            if q not in before:
                before[q], depth[q] = p, depth[p] + 1
                todo.append(q)
    most = max(depth.values())
    return min(p for p, d in depth.items() if d == most), before


def longest_path(pixels: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest shortest path of a skeleton without loops, from its smaller end; empty if no pixel is an end.

    Two sweeps: the farthest pixel from anywhere is one end, the farthest from it
    the other. What isn't on the path are arms, which are cut so. Of several
    pieces that with the most pixels counts, then the one with the smallest.
    """
    graph, pieces, seen = pixel_graph(pixels), [], set()
    for p in sorted(pixels):
        if p not in seen:
            found = set(sweep(graph, p)[1])
            seen |= found
            pieces.append(found)
    piece = max(pieces, key=len, default=set())
    if not any(len(graph[p]) <= 1 for p in piece):
        return []
    one, _ = sweep(graph, min(piece))
    two, before = sweep(graph, one)
    path = [two]
    while before[path[-1]] is not None:
        path.append(before[path[-1]])
    return path if path[0] <= path[-1] else path[::-1]


def spine_of_mask(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pixels of a mask's centre line in order; empty for a mask without one (fewer than two pixels, or a ring)."""
    if len(points) < 2:
        return []
    p = np.array(points, dtype=int)
    low = p.min(axis=0)
    grid = np.zeros(p.max(axis=0) - low + 1, dtype=bool)
    grid[tuple((p - low).T)] = True
    path = longest_path({(int(x), int(y)) for x, y in np.argwhere(thin(grid))})
    return [(x + int(low[0]), y + int(low[1])) for x, y in path] if len(path) > 1 else []


#: Shapes whose spines a task remembers.
SHAPES = 4096


@lru_cache(maxsize=SHAPES)
def spine_of_shape(shape: bytes) -> np.ndarray:
    """The spine of a closed outline (int64 x and y of its points in turn, the least of each 0); a shape's place doesn't matter for it."""
    points = [{"x": x, "y": y} for x, y in np.frombuffer(shape, np.int64).reshape(-1, 2).tolist()]
    return np.array(spine_of_mask(fill_points(points)), np.int64).reshape(-1, 2)


def _spines(outlines: pd.Series) -> pd.Series:
    def one(ps: Iterable[dict] | None) -> list[dict]:
        points = np.array([(p["x"], p["y"]) for p in ps] if ps is not None else [], np.int64).reshape(-1, 2)
        if not len(points):
            return []
        low = points.min(axis=0)
        return [{"x": x, "y": y} for x, y in (spine_of_shape((points - low).tobytes()) + low).tolist()]

    return outlines.map(one)


def spine_from_outline(outline: Column) -> Column:
    """array<struct<x, y>>: the centre line of a closed outline's mask; empty if there is none, also for null."""
    return F.pandas_udf(_spines, POINTS)(outline)


def spine_rows(df: DataFrame, spine: str, *keys: str) -> DataFrame:
    """keys, place, x, y: a row for each point of each spine."""
    return df.select(*keys, F.posexplode(spine).alias("place", "p")).select(*keys, "place", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))


def treated_spines(df: DataFrame, spine: str, width: int = 13, order: int = 3, n: int = 50, key: str = "bid", by: str = "frame") -> DataFrame:
    """key, by, place, x, y: spines smoothed along themselves, ``n`` points at equal distances, each facing like the one before.

    Spines of at most 1.5 * ``width`` points are left out, and the one after such a gap is read as it is.
    """
    weights, low = savgol_weights(width, order), 1.5 * width

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def treated(found: pd.Series) -> pd.Series:
        def one(ps: Iterable[dict] | None) -> list[dict] | None:
            if ps is None or len(ps) <= low:
                return None
            line = spaced_line(*(smooth_line(np.array([p[c] for p in ps], float), weights) for c in ("x", "y")), n)
            return None if line is None else [{"x": x, "y": y} for x, y in zip(*(v.tolist() for v in line))]

        return found.map(one)

    rows = df.select(key, by, treated(spine).alias("_points"))
    faced = kept_direction(rows, F.get("_points", F.lit(0)), F.element_at("_points", -1), (key,), by)
    out = faced.select(key, by, "turned", F.posexplode("_points").alias("place", "p"))
    return out.select(key, by, F.when(F.col("turned"), n - 1 - F.col("place")).otherwise(F.col("place")).cast("long").alias("place"), "p.x", "p.y")


def width_at(spine: Column, outline: Column, place: Column) -> Column:
    """The width of a closed outline across a spine's step from ``place`` to the next (at its end: the last step); -1 if the outline isn't met twice.

    From the middle of the step a line at right angles meets the outline's edges
    (half a pixel of slack); the nearest crossings on both sides count, or the two
    nearest where all are on one side. A step without length is taken along x.
    Edges along an axis count like others.
    """
    i = F.least(place, F.size(spine) - 2)
    p, q = F.get(spine, i), F.get(spine, i + 1)
    dx, dy = F.when((q.x == p.x) & (q.y == p.y), F.lit(1e-6)).otherwise(q.x - p.x), (q.y - p.y).cast("double")
    line = F.struct(((p.x + q.x) / 2).alias("x"), ((p.y + q.y) / 2).alias("y"), (dy / F.hypot(dx, dy)).alias("u"), (-dx / F.hypot(dx, dy)).alias("v"))

    def crossings(at: Column) -> Column:
        def one(a: Column, b: Column) -> Column:
            ex, ey = b.x - a.x, b.y - a.y
            far = F.try_divide(ex * (at.y - a.y) - ey * (at.x - a.x), ey * at.u - ex * at.v)
            x, y = at.x + far * at.u, at.y + far * at.v
            inside = (x + 0.5 >= F.least(a.x, b.x)) & (x - 0.5 <= F.greatest(a.x, b.x)) & (y + 0.5 >= F.least(a.y, b.y)) & (y - 0.5 <= F.greatest(a.y, b.y))
            return F.when(inside, far)

        following = F.concat(F.slice(outline, 2, F.greatest(F.size(outline) - 1, F.lit(0))), F.slice(outline, 1, 1))
        return F.array_sort(F.array_distinct(F.array_compact(F.zip_with(outline, following, one))))

    def between(found: Column) -> Column:
        below, above = F.filter(found, lambda d: d < 0), F.filter(found, lambda d: d >= 0)
        both = F.get(above, F.lit(0)) - F.element_at(below, -1)
        one_side = F.when(F.size(below) == 0, F.get(above, F.lit(1)) - F.get(above, F.lit(0))).otherwise(F.element_at(below, -1) - F.element_at(below, -2))
        return F.when(F.size(found) < 2, F.lit(-1.0)).when((F.size(below) > 0) & (F.size(above) > 0), both).otherwise(one_side)

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when((F.size(spine) >= 2) & (F.size(outline) > 0), once(line, lambda at: once(crossings(at), between)))


def widths(df: DataFrame, spine: str, outline: str, parts: tuple[float, ...] = (0.2, 0.5, 0.8)) -> DataFrame:
    """``df`` with width20, width50, ...: across the spine at these shares of its points."""
    at = lambda part: F.floor(F.size(spine) * part).cast("int")
    return df.withColumns({f"width{round(100 * part)}": width_at(F.col(spine), F.col(outline), at(part)) for part in parts})


def speed_along(one: Column, two: Column, seconds: Column, across: bool = False) -> Column:
    """Mean speed of a spine along (or across) itself between two times: its displacement over its points and the time; null if no time passed."""
    return F.try_divide(displacement_along(one, two, across), F.size(one) * F.when(seconds > 0, seconds))
