"""Column functions on points and polylines (arrays of struct<x, y>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codec writes three steps of two bits into a character from "0" on:
# 0 is one pixel left, 1 right, 2 down (y - 1), 3 up (y + 1).
FIRST_CHARACTER = 48


def _steps(code: Column, n: Column) -> Column:
    """The first n two-bit steps of a code."""
    bits = lambda c: F.ascii(c) - FIRST_CHARACTER
    three = F.transform(F.split(code, ""), lambda c: F.array(*[F.shiftright(bits(c), k).bitwiseAND(F.lit(3)) for k in (4, 2, 0)]))
    return F.slice(F.flatten(F.when(F.length(code) > 0, three).otherwise(F.array().cast("array<array<int>>"))), 1, n)


def _dx(s: Column) -> Column:
    return F.when(s == 0, -1).when(s == 1, 1).otherwise(0)


def _dy(s: Column) -> Column:
    return F.when(s == 2, -1).when(s == 3, 1).otherwise(0)


def decode_outline(x: Column, y: Column, n: Column, code: Column) -> Column:
    """The points of an outline code: the start and one for each step; a short code gives fewer. Null parts give null."""
    start = F.array(F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))
    add = lambda points, s: F.concat(points, F.array(F.struct((F.element_at(points, -1).x + _dx(s)).alias("x"), (F.element_at(points, -1).y + _dy(s)).alias("y"))))
    return F.aggregate(_steps(code, n), start, add)


def outline_extent(x: Column, y: Column, n: Column, code: Column) -> Column:
    """steps, last point and bounds of an outline code, without building its points."""
    at = lambda v, dx, dy: F.struct(
        (v.steps + 1).alias("steps"), (v.x + dx).alias("x"), (v.y + dy).alias("y"),
        F.least(v.x_min, v.x + dx).alias("x_min"), F.greatest(v.x_max, v.x + dx).alias("x_max"), F.least(v.y_min, v.y + dy).alias("y_min"), F.greatest(v.y_max, v.y + dy).alias("y_max"),
    )
    x, y = x.cast("int"), y.cast("int")
    zero = F.struct(F.lit(0).alias("steps"), x.alias("x"), y.alias("y"), x.alias("x_min"), x.alias("x_max"), y.alias("y_min"), y.alias("y_max"))
    return F.aggregate(_steps(code, n), zero, lambda v, s: at(v, _dx(s), _dy(s)))


def encode_outline(points: Column) -> Column:
    """struct<x, y, n, code>; null where two neighbours aren't one pixel apart along an axis."""
    step = lambda p, q: F.when((q.x == p.x - 1) & (q.y == p.y), 0).when((q.x == p.x + 1) & (q.y == p.y), 1).when((q.x == p.x) & (q.y == p.y - 1), 2).when((q.x == p.x) & (q.y == p.y + 1), 3)
    n = F.size(points) - 1
    steps = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), step)
    at = lambda i: F.coalesce(F.get(steps, i), F.lit(0))
    chars = F.transform(F.sequence(F.lit(0), F.ceil(n / 3) - 1), lambda k: F.char(FIRST_CHARACTER + 16 * at((3 * k).cast("int")) + 4 * at((3 * k + 1).cast("int")) + at((3 * k + 2).cast("int"))))
    code = F.when(n == 0, F.lit("")).otherwise(F.array_join(chars, ""))
    good = (F.size(points) > 0) & F.forall(F.when(n > 0, steps).otherwise(F.array().cast("array<int>")), lambda s: s.isNotNull())
    return F.when(good, F.struct(F.get(points, F.lit(0)).x.alias("x"), F.get(points, F.lit(0)).y.alias("y"), n.alias("n"), code.alias("code")))


def _pairs(points: Column, f) -> Column:
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p.x - q.x, p.y - q.y)


def polyline_length(points: Column) -> Column:
    """Sum of the steps; 0 for fewer than two points."""
    return _sum(_pairs(points, distance))


def curvature(points: Column) -> Column:
    """Mean curvature (4 * area / product of the sides) at the points from the third to the one before the last; null where there are none."""
    i = F.sequence(F.lit(2), F.size(points) - 2)

    def at(k: Column) -> Column:
        p, q, t = (F.get(points, k + d) for d in (-1, 0, 1))
        a, b, c = distance(p, q), distance(t, q), distance(p, t)
        s = (a + b + c) / 2
        return F.coalesce(F.try_divide(4 * F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0))), a * b * c), F.lit(0.0))

    return F.when(F.size(points) > 3, _sum(F.transform(i, at)) / (F.size(points) - 3))


def displacement_along(one: Column, two: Column, across: bool = False) -> Column:
    """How far a curve moved along (or across) itself: summed over its steps, from curve two to curve one; steps of no length count 0."""
    n = F.greatest(F.least(F.size(one) - 1, F.size(two)), F.lit(0))
    step = _pairs(one, lambda p, q: F.struct((q.x - p.x).alias("x"), (q.y - p.y).alias("y")))
    move = F.zip_with(F.slice(one, 1, n), F.slice(two, 1, n), lambda p, q: F.struct((p.x - q.x).alias("x"), (p.y - q.y).alias("y")))
    size = lambda v: F.hypot(v.x, v.y)
    if across:
        value = lambda d, v: F.abs(F.try_divide(d.x * v.y - d.y * v.x, size(v)))
    else:
        value = lambda d, v: F.try_divide(d.x * v.x + d.y * v.y, size(v))
    return _sum(F.zip_with(move, F.slice(step, 1, n), lambda d, v: F.coalesce(value(d, v), F.lit(0.0))))


def rotate(x: Column, y: Column, radians: float, by: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """A point turned around the origin, then moved."""
    c, s = F.cos(F.lit(radians)), F.sin(F.lit(radians))
    return c * x - s * y + by[0], s * x + c * y + by[1]


def boxes_overlap(a: Column, b: Column) -> Column:
    """Boxes of struct<x_min, x_max, y_min, y_max>; touching counts."""
    return (a.x_min <= b.x_max) & (b.x_min <= a.x_max) & (a.y_min <= b.y_max) & (b.y_min <= a.y_max)


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a.x_min, b.x_min).alias("x_min"), F.greatest(a.x_max, b.x_max).alias("x_max"), F.least(a.y_min, b.y_min).alias("y_min"), F.greatest(a.y_max, b.y_max).alias("y_max"))


def circle_through(a: Column, b: Column, c: Column) -> Column:
    """struct<x, y, r> of the circle through three points; null where they are in line."""
    d = 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y))
    sq = lambda p: p.x * p.x + p.y * p.y
    x = F.try_divide(sq(a) * (b.y - c.y) + sq(b) * (c.y - a.y) + sq(c) * (a.y - b.y), d)
    y = F.try_divide(sq(a) * (c.x - b.x) + sq(b) * (a.x - c.x) + sq(c) * (b.x - a.x), d)
    return F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y"), F.hypot(a.x - x, a.y - y).alias("r")))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def deskew(x: Column, e: float = 0.1) -> Column:
    return F.asinh(x / e)


def reskew(x: Column, e: float = 0.1) -> Column:
    return F.sinh(x) * e


def time_key(t: Column) -> Column:
    """Seconds with three decimals, '?' for the point."""
    return F.replace(F.format_string("%.3f", t), F.lit("."), F.lit("?"))
