"""Masks and pixels as rows: filling outlines, overlaps, backgrounds, object pixels, skeletons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.batches import by_group
from trackloom.operators.components import connected_components
from trackloom.plans.lineage import stored

PIXELS = "array<struct<x:int,y:int>>"


def fill_points(points: list) -> list[tuple[int, int]]:
    """The pixels of a closed outline and inside it."""
    if not points:
        return []
    p = np.array([(q["x"], q["y"]) for q in points], dtype=int)
    low = p.min(axis=0) - 1
    size = p.max(axis=0) - low + 2
    wall = np.zeros(size, dtype=bool)
    wall[tuple((p - low).T)] = True
    outside = np.zeros_like(wall)
    outside[0, :] = outside[-1, :] = outside[:, 0] = outside[:, -1] = True
    while True:
        grown = outside.copy()
        grown[1:] |= outside[:-1]
        grown[:-1] |= outside[1:]
        grown[:, 1:] |= outside[:, :-1]
        grown[:, :-1] |= outside[:, 1:]
        grown &= ~wall
        if (grown == outside).all():
            break
        outside = grown
    return [(int(x), int(y)) for x, y in np.argwhere(~outside) + low]


def mask_pixels(df: DataFrame, points: str, *keys: str) -> DataFrame:
    """keys, x, y: a row for each pixel of each row's filled outline."""

    @F.pandas_udf(PIXELS)
    def filled(series: pd.Series) -> pd.Series:
        return series.map(lambda ps: [{"x": x, "y": y} for x, y in fill_points(list(ps) if ps is not None else [])])

    return df.select(*keys, F.explode(filled(points)).alias("p")).select(*keys, "p.x", "p.y")


def overlaps(parents: DataFrame, children: DataFrame, parent: str, child: str, within: tuple[str, ...] = ()) -> DataFrame:
    """within, parent, child, pixels in common: masks as rows (id, x, y); only masks of one frame or collision (``within``) are compared, where given."""
    left, right = parents.select(*within, parent, "x", "y").distinct(), children.select(*within, child, "x", "y").distinct()
    return left.join(right, [*within, "x", "y"]).groupBy(*within, parent, child).agg(F.count("*").alias("pixels"))


def resolve_pairs(found: DataFrame, collision: str, margin: int) -> DataFrame:
    """collision, straight, crossed, verdict for two parents and two children each: found (collision, p, c in 0..1, pixels).

    The pairing with more common pixels wins if it leads by more than ``margin``.
    """
    same = F.col("p") == F.col("c")
    sums = found.groupBy(collision).agg(F.sum(F.when(same, F.col("pixels")).otherwise(0)).alias("straight"), F.sum(F.when(~same, F.col("pixels")).otherwise(0)).alias("crossed"))
    verdict = F.when(F.col("straight") - F.col("crossed") > margin, "straight").when(F.col("crossed") - F.col("straight") > margin, "crossed").otherwise("open")
    return sums.withColumn("verdict", verdict)


def background(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, x, y, value: the brightest value of a pixel over the images (objects are dark)."""
    return pixels.groupBy(*keys, "x", "y").agg(F.max("value").alias("value"))


def dark_pixels(pixels: DataFrame, ground: DataFrame, threshold: float) -> DataFrame:
    """Pixels darker than the background by more than ``threshold``."""
    return pixels.join(ground.withColumnRenamed("value", "ground"), ["x", "y"]).where(F.col("ground") - F.col("value") > threshold).drop("ground")


def threshold_sweep(pixels: DataFrame, ground: DataFrame, thresholds: list[float], image: str) -> DataFrame:
    """image, threshold, pixels darker than the background by more than that."""
    joined = pixels.join(ground.withColumnRenamed("value", "ground"), ["x", "y"]).withColumn("drop", F.col("ground") - F.col("value"))
    levels = joined.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return levels.groupBy(image, "threshold").agg(F.count_if(F.col("drop") > F.col("threshold")).alias("pixels"))


# Places round a cell, in order.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def ring_of(padded: np.ndarray) -> list[np.ndarray]:
    """Views of the eight neighbours of each cell within a border of one."""
    h, w = padded.shape
    return [padded[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy, dx in RING]


def thin(mask: np.ndarray) -> np.ndarray:
    """A skeleton by parallel thinning: in turn from two sides, pixels go that have 2 to 6 neighbours and one run of them."""
    m = np.pad(mask.astype(bool), 1)
    inner = m[1:-1, 1:-1]
    while True:
        gone = False
        for side in (0, 1):
            n = np.stack(ring_of(m))
            count = n.sum(axis=0, dtype=np.uint8)
            runs = (n[1:] & ~n[:-1]).sum(axis=0, dtype=np.uint8) + (n[0] & ~n[-1])
            up, right, down, left = n[0], n[2], n[4], n[6]
            open_ = (~(up & right & down) & ~(right & down & left)) if side == 0 else (~(up & right & left) & ~(up & down & left))
            going = inner & (count >= 2) & (count <= 6) & (runs == 1) & open_
            if going.any():
                inner &= ~going
                gone = True
        if not gone:
            return inner


def ends_and_branches(skeleton: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(row, column) of the pixels with one run of neighbours, and of those with three or more."""
    m = np.pad(skeleton.astype(bool), 1)
    n = np.stack(ring_of(m))
    runs = (n[1:] & ~n[:-1]).sum(axis=0, dtype=np.uint8) + (n[0] & ~n[-1])
    at = lambda f: [(y, x) for y, x in np.argwhere(m[1:-1, 1:-1] & f).tolist()]
    return at(runs == 1), at(runs >= 3)


def skeletons(masks: DataFrame, key: str) -> DataFrame:
    """key, pixels, skeleton pixels, ends, branches of each mask (rows key, x, y); a group is a mask's distinct pixels, which its grid bounds."""
    schema = f"{key} {masks.schema[key].dataType.simpleString()}, pixels long, thin long, ends long, branches long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy() - pdf["x"].min(), pdf["y"].to_numpy() - pdf["y"].min()
        grid = np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        grid[y, x] = True
        s = thin(grid)
        ends, branches = ends_and_branches(s)
        return pd.DataFrame([(pdf[key].iloc[0], int(grid.sum()), int(s.sum()), len(ends), len(branches))], columns=[key, "pixels", "thin", "ends", "branches"])

    return masks.select(key, "x", "y").distinct().groupBy(key).applyInPandas(one, schema)


def pixel_components(pixels: DataFrame, image: str, batch_rows: int = 1) -> DataFrame:
    """image, label, pixels of the four-connected objects of each image (rows image, x, y)."""
    schema = f"{image} {pixels.schema[image].dataType.simpleString()}, label long, pixels long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        cells = {(a, b): k for k, (a, b) in enumerate(zip(x.tolist(), y.tolist()))}
        label, sizes = {}, []
        for start in cells:
            if start in label:
                continue
            stack, n = [start], 0
            label[start] = len(sizes)
            while stack:
                a, b = stack.pop()
                n += 1
                for q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if q in cells and q not in label:
                        label[q] = len(sizes)
                        stack.append(q)
            sizes.append(n)
        return pd.DataFrame({image: pdf[image].iloc[0], "label": range(len(sizes)), "pixels": sizes})

    return pixels.select(image, "x", "y").distinct().groupBy(image).applyInPandas(one, schema)


def tiled_components(pixels: DataFrame, image: str, tile: int = 256) -> DataFrame:
    """image, x0, y0 (the object's first pixel by x, then y), pixels, x_min, x_max, y_min, y_max, x, y (its centre) of the four-connected objects of rows (image, x, y).

    Each tile of an image finds its own objects; pixels on both sides of a tile's
    border tell which of them are one, and components of those pairs unite them.
    So an image is as many tasks as it has tiles, and only borders and one row an
    object of a tile are joined.
    """
    kind = pixels.schema[image].dataType.simpleString()
    cells = pixels.select(F.col(image).alias("image"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).dropna().distinct()
    cells = cells.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def label(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        todo = set(rows)
        for start in sorted(rows):
            if start not in todo:
                continue
            stack, found = [start], [start]
            todo.discard(start)
            while stack:
                x, y = stack.pop()
                for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if q in todo:
                        todo.discard(q)
                        stack.append(q)
                        found.append(q)
            for x, y in found:
                yield key[0], x, y, *start

    parts = stored(by_group(cells, ["image", "tx", "ty"], ["x", "y"], label, f"image {kind}, x int, y int, lx int, ly int"), "labels")
    name = F.struct("image", "lx", "ly")
    pairs = None
    for axis in ("x", "y"):
        at = F.col(axis)
        last = parts.where(F.pmod(at, F.lit(tile)) == tile - 1).withColumn(axis, at + 1).select("image", "x", "y", name.alias("src"))
        first = parts.where(F.pmod(at, F.lit(tile)) == 0).select("image", "x", "y", name.alias("dst"))
        met = last.join(first, ["image", "x", "y"]).select("src", "dst")
        pairs = met if pairs is None else pairs.union(met)
    united = connected_components(pairs)
    own = parts.groupBy("image", "lx", "ly").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))])
    whole = own.withColumn("node", name).join(united, "node", "left").withColumn("object", F.coalesce("component", "node"))
    ends = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    out = whole.groupBy("object").agg(F.sum("n").alias("pixels"), *ends, *[(F.sum(f"{c}_sum") / F.sum("n")).alias(c) for c in ("x", "y")])
    return out.select(F.col("object.image").alias(image), F.col("object.lx").alias("x0"), F.col("object.ly").alias("y0"), "pixels", "x_min", "x_max", "y_min", "y_max", "x", "y")


def scan_matches(objects: DataFrame, tracked: DataFrame, image: str, near: float) -> DataFrame:
    """image, true_pos, false_neg, false_pos, joined: how the objects in an image (rows image, x, y) and the tracked ones (image, bid, x, y) agree.

    A tracked object goes to the nearest object within ``near`` (of equally near
    ones to the smaller x, then y); true_pos: tracked ones with an object,
    false_neg: objects without one, false_pos: tracked ones without, joined:
    objects that several tracked ones share. Both are put on cells four times as
    long as ``near``, a tracked one on all that it may see something in (9 of 4): an equi-join.
    """
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / (4 * near))
    reach = near * (1 + 1e-6)
    cells = lambda c: F.sequence(cell(c, -reach), cell(c, reach))
    around = F.explode(F.flatten(F.transform(cells("x"), lambda i: F.transform(cells("y"), lambda j: F.struct(i.alias("cx"), j.alias("cy"))))))
    there = objects.select(image, F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    looked = tracked.select(image, "bid", "x", "y", around.alias("c")).select(image, "bid", "x", "y", "c.cx", "c.cy")
    away = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    close = looked.join(there, [image, "cx", "cy"]).withColumn("away", away).where(F.col("away") <= near)
    best = close.groupBy(image, "bid").agg(F.min(F.struct("away", "ox", "oy")).alias("m"))
    taken = best.groupBy(image, "m.ox", "m.oy").agg(F.count("*").alias("n")).groupBy(image).agg(F.count("*").alias("found"), F.sum("n").alias("true_pos"), F.count_if(F.col("n") > 1).alias("joined"))
    sizes = objects.groupBy(image).agg(F.count("*").alias("objects")).join(tracked.groupBy(image).agg(F.count("*").alias("blobs")), image, "full").join(taken, image, "left").na.fill(0)
    return sizes.select(image, "true_pos", (F.col("objects") - F.col("found")).alias("false_neg"), (F.col("blobs") - F.col("true_pos")).alias("false_pos"), "joined")


def rows_of(array: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(x, y, value) of an image."""
    for (y, x), v in np.ndenumerate(array):
        yield x, y, float(v)
