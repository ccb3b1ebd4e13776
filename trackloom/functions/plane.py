"""Column functions on vectors, lines, boxes and circles (points: struct<x, y>)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def between(p: Column, q: Column) -> Column:
    """The vector from p to q."""
    return point(q.x - p.x, q.y - p.y)


def perpendicular(v: Column) -> Column:
    """The vector turned a quarter to the left."""
    return point(-v.y, v.x)


def unsigned_angle(a: Column, b: Column) -> Column:
    """Between 0 and pi; null for a vector of no length."""
    cosine = F.try_divide(a.x * b.x + a.y * b.y, F.hypot(a.x, a.y) * F.hypot(b.x, b.y))
    return F.acos(F.when(cosine > 1, 1.0).when(cosine < -1, -1.0).otherwise(cosine))


def line_crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<x, y, distance>: where the line through a and b meets that through c and d, and how far from a, in the direction of b; null where they are parallel."""
    det = (b.x - a.x) * (d.y - c.y) - (b.y - a.y) * (d.x - c.x)
    part = F.try_divide((c.x - a.x) * (d.y - c.y) - (c.y - a.y) * (d.x - c.x), det)
    met = F.struct((a.x + part * (b.x - a.x)).alias("x"), (a.y + part * (b.y - a.y)).alias("y"), (part * F.hypot(b.x - a.x, b.y - a.y)).alias("distance"))
    return F.when(part.isNotNull(), met)


def distance_to_line(p: Column, a: Column, b: Column) -> Column:
    """Of p from the line through a and b; null where these are one point."""
    return F.try_divide(F.abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)), F.hypot(b.x - a.x, b.y - a.y))


def flipped(box: Column) -> Column:
    """A box with x and y changed about."""
    return F.struct(box.y_min.alias("x_min"), box.y_max.alias("x_max"), box.x_min.alias("y_min"), box.x_max.alias("y_max"))


def circle_points(x: Column, y: Column, r: Column, n: int) -> Column:
    """n points around a circle, and the first again."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: point(x + r * F.cos(2 * math.pi * k / n), y + r * F.sin(2 * math.pi * k / n)))


def region_points(kind: Column, x: Column, y: Column, r: Column, corners: Column, n: int = 100) -> Column:
    """The outline of a circle or polygon region; other kinds give null."""
    return F.when(kind == "circle", circle_points(x, y, r, n)).when(kind == "polygon", corners)


def same_way(line: Column, other: Column) -> Column:
    """``other``, turned round if its last point is nearer to the first of ``line`` than its first."""
    start, a, b = F.get(line, F.lit(0)), F.get(other, F.lit(0)), F.get(other, F.size(other) - 1)
    square = lambda p: (p.x - start.x) * (p.x - start.x) + (p.y - start.y) * (p.y - start.y)
    return F.when(square(a) > square(b), F.reverse(other)).otherwise(other)


def closed(outline: Column) -> Column:
    """With the first point again at its end, unless it is there."""
    first = F.get(outline, F.lit(0))
    return F.when((F.size(outline) == 0) | (F.get(outline, F.size(outline) - 1) == first), outline).otherwise(F.concat(outline, F.array(first)))


def or_centroid(outline: Column, x: Column, y: Column) -> Column:
    """The outline, or the centroid alone where there is none."""
    return F.when(F.size(F.coalesce(outline, F.array().cast("array<struct<x:double,y:double>>"))) > 0, outline).otherwise(F.array(point(x, y)))


def padded(values: Column, length: int) -> Column:
    """An array filled up with nulls; a longer one stays whole."""
    return F.concat(values, F.array_repeat(F.lit(None), F.greatest(F.lit(length) - F.size(values), F.lit(0))))


def aspect(box: Column) -> Column:
    """Width over height; null for a flat box."""
    return F.try_divide(box.x_max - box.x_min, box.y_max - box.y_min)


def grown(box: Column, by: float) -> Column:
    """A box with a margin on all sides."""
    return F.struct((box.x_min - by).alias("x_min"), (box.x_max + by).alias("x_max"), (box.y_min - by).alias("y_min"), (box.y_max + by).alias("y_max"))


def contains(a: Column, b: Column) -> Column:
    """Is box b inside a? Touching counts."""
    return (a.x_min <= b.x_min) & (a.x_max >= b.x_max) & (a.y_min <= b.y_min) & (a.y_max >= b.y_max)


def squared(box: Column) -> Column:
    """The smallest square around a box with its centre."""
    half = F.greatest(box.x_max - box.x_min, box.y_max - box.y_min) / 2
    x, y = (box.x_min + box.x_max) / 2, (box.y_min + box.y_max) / 2
    return F.struct((x - half).alias("x_min"), (x + half).alias("x_max"), (y - half).alias("y_min"), (y + half).alias("y_max"))
