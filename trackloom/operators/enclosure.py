"""The four walls round a bright plate in images: dark pixels, rays from the middle, fitted lines, corners and a polygon.

An image is rows (image, x, y, value) of a whole grid from (0, 0). All steps are
windows along rows or columns and aggregates, so an image may span many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("left", "right", "top", "bottom")
CORNERS = {"tl": ("left", "top"), "tr": ("left", "bottom"), "bl": ("right", "top"), "br": ("right", "bottom")}


def _box_sum(value: Column, image: str, along: str, low: int, high: int) -> Column:
    across = "y" if along == "x" else "x"
    return F.sum(value).over(Window.partitionBy(image, across).orderBy(along).rangeBetween(low, high))


def opened(df: DataFrame, flag: str, size: int, image: str = "image") -> DataFrame:
    """``flag`` only where a square of ``size`` set pixels fits: an erosion and a dilation, each along both axes in turn."""
    half = size // 2
    low, high = -half, size - half - 1
    for axis in ("x", "y"):
        df = df.withColumn(flag, _box_sum(F.col(flag).cast("int"), image, axis, low, high) == size)
    for axis in ("x", "y"):
        df = df.withColumn(flag, _box_sum(F.col(flag).cast("int"), image, axis, -high, -low) > 0)
    return df


def wall_points(df: DataFrame, kernel: int = 30, reach: int = 300, step: int = 15, image: str = "image") -> DataFrame:
    """image, side, x, y: where rays from the middle lines first meet dark pixels, or else the image's edge.

    Dark is under the image's mean, in squares of ``kernel`` pixels at least. Rays
    start every ``step`` pixels up to ``reach`` from the centre, as far as the image goes.
    """
    mean = F.avg("value").over(Window.partitionBy(image))
    dark = opened(df.withColumn("dark", F.col("value") < mean), "dark", kernel, image)
    size = df.groupBy(image).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    rows = dark.join(size, image).withColumns({"cx": F.floor(F.col("w") / 2).cast("int"), "cy": F.floor(F.col("h") / 2).cast("int")})

    ray = lambda c: (F.col(c) - F.col(f"c{c}") >= -reach) & (F.col(c) - F.col(f"c{c}") < reach) & (F.pmod(F.col(c) - F.col(f"c{c}") + reach, F.lit(step)) == 0)

    def seen(side: str, along: str, across: str, ahead: bool) -> Column:
        """A pixel's part in the ray of its row or column: how far from the middle it is, if it is dark and on that side."""
        away = (F.col(along) - F.col(f"c{along}")) if ahead else (F.col(f"c{along}") - F.col(along))
        edge = (F.col("w" if along == "x" else "h") - 1 - F.col(f"c{along}")) if ahead else F.col(f"c{along}")
        fields = F.struct(F.lit(side).alias("side"), F.col(across).cast("int").alias("ray"), F.col(f"c{along}").alias("middle"), edge.cast("int").alias("edge"), F.when(F.col("dark") & (away >= 0), away.cast("int")).alias("away"))
        return F.when(ray(across), fields)

    parts = [seen("left", "x", "y", False), seen("right", "x", "y", True), seen("top", "y", "x", False), seen("bottom", "y", "x", True)]
    met = rows.select(image, F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy(image, "p.side", "p.ray", "p.middle", "p.edge").agg(F.min("p.away").alias("away"))
    far = F.coalesce("away", "edge")
    at = F.when(F.col("side").isin("left", "top"), F.col("middle") - far).otherwise(F.col("middle") + far)
    level = F.col("side").isin("left", "right")
    return met.select(image, "side", F.when(level, at).otherwise(F.col("ray")).cast("double").alias("x"), F.when(level, F.col("ray")).otherwise(at).cast("double").alias("y"))


def wall_lines(points: DataFrame, image: str = "image") -> DataFrame:
    """image, side, m, b: least-squares lines y = m * x + b; where all x are one, m is null and b is that x."""
    flat = F.min("x") == F.max("x")
    m, b = F.when(~flat, F.regr_slope("y", "x")), F.when(flat, F.min("x")).otherwise(F.regr_intercept("y", "x"))
    return points.groupBy(image, "side").agg(m.alias("m"), b.alias("b"))


def meeting(a: Column, b: Column) -> Column:
    """struct<x, y> where two lines (structs of m and b) meet; null if they have one direction."""
    x = F.when(a.m.isNull() & b.m.isNull(), F.lit(None)).when(a.m.isNull(), a.b).when(b.m.isNull(), b.b).otherwise(F.try_divide(b.b - a.b, a.m - b.m))
    y = F.when(a.m.isNull(), b.m * x + b.b).otherwise(a.m * x + a.b)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def enclosures(lines: DataFrame, image: str = "image") -> DataFrame:
    """image, tl, tr, bl, br (structs of x and y), h1, h2, h, v1, v2, v, aspect of the four lines of each image.

    tl is where the left and the top wall meet, tr the left and the bottom one
    (images are seen with x downwards), bl and br those of the right wall.
    """
    row = lines.groupBy(image).agg(*[F.max(F.when(F.col("side") == s, F.struct("m", "b"))).alias(s) for s in SIDES])
    row = row.withColumns({c: meeting(F.col(p), F.col(q)) for c, (p, q) in CORNERS.items()})
    length = lambda p, q: F.hypot(F.col(p).x - F.col(q).x, F.col(p).y - F.col(q).y)
    row = row.withColumns({"h1": length("tl", "tr"), "h2": length("bl", "br"), "v1": length("tl", "bl"), "v2": length("tr", "br")})
    row = row.withColumns({"h": (F.col("h1") + F.col("h2")) / 2, "v": (F.col("v1") + F.col("v2")) / 2})
    return row.withColumn("aspect", F.try_divide("h", "v")).drop(*SIDES)


def polygon(border: float, corner: float) -> Column:
    """Eight points of an enclosure's corners, cut off by ``corner`` and moved inwards by ``border``; null without corners or where a side has no length."""

    def side(p: str, q: str, way: int) -> tuple[Column, Column]:
        dx, dy = F.col(p).x - F.col(q).x, F.col(p).y - F.col(q).y
        size = F.nullif(F.hypot(dx, dy), F.lit(0.0))
        nx, ny = dx / size, dy / size
        move = lambda at, sign: F.struct((F.col(at).x + way * ny * border + sign * nx * corner).alias("x"), (F.col(at).y - way * nx * border + sign * ny * corner).alias("y"))
        return move(p, -1), move(q, 1)

    (tl_a, bl_a), (tr_a, br_a) = side("tl", "bl", 1), side("tr", "br", -1)
    (tl_b, tr_b), (bl_b, br_b) = side("tl", "tr", -1), side("bl", "br", 1)
    points = F.array(tl_a, tl_b, tr_b, tr_a, br_a, br_b, bl_b, bl_a)
    return F.when(F.forall(points, lambda p: p.x.isNotNull() & p.y.isNotNull()), points)


def longest_middle(row: DataFrame) -> DataFrame:
    """``row`` with p and q, the middles of the two walls that are farthest from each other, and span, the longer mean side."""
    middle = lambda a, b: F.struct(((F.col(a).x + F.col(b).x) / 2).alias("x"), ((F.col(a).y + F.col(b).y) / 2).alias("y"))
    wide = F.col("h") > F.col("v")
    p, q = F.when(wide, middle("tl", "bl")).otherwise(middle("tl", "tr")), F.when(wide, middle("tr", "br")).otherwise(middle("bl", "br"))
    return row.withColumns({"p": p, "q": q, "span": F.greatest("h", "v")})
