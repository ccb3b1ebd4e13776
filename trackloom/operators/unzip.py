"""Following two bodies through the frames in which they are one mask.

A collision's masks travel as one row each, sorted by collision and frame; tasks
hold one collision at a time. The two parents' masks are carried from frame to
frame: what is still covered stays, and each body grows back what it lost, first
where it lost it. Before each frame the carried masks are held against the
children's; the walk ends as soon as one pairing leads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.batches import ROWS, arrow_schema, batch_of, by_group, dealt, whole_groups
from trackloom.operators.images import ends_and_branches, ring_of, thin

# Pixels nearer than NEAR to one body and farther than FAR from the other are that body's; bodies grow within REACH pixels.
NEAR, FAR, REACH = 5, 10, 10
WITHOUT_ENDS = 5.0  # the weight of any pixel of a body whose skeleton has fewer than two ends
FAR_AWAY = 10**9


def distance_from(mask: np.ndarray, most: int = FAR_AWAY) -> np.ndarray:
    """Steps (to any of eight neighbours) from each cell to the nearest one of the mask; FAR_AWAY without any, and beyond ``most``.

    The fronts of all the mask's pixels move by one step at once.
    """
    d = np.where(mask, 0, FAR_AWAY).astype(np.int64)
    reached, step = mask.copy(), 0
    while step < most and not reached.all():
        front = reached.copy()
        front[1:] |= reached[:-1]
        front[:-1] |= reached[1:]
        wide = front.copy()
        wide[:, 1:] |= front[:, :-1]
        wide[:, :-1] |= front[:, 1:]
        step += 1
        new = wide & ~reached
        if not new.any():
            break
        d[new] = step
        reached = wide
    return d


def distances(masks: DataFrame, *keys: str, margin: int = 0) -> DataFrame:
    """keys, x, y, distance: each cell of a mask's box, ``margin`` wider on all sides, with its steps to the nearest pixel of the mask (rows keys, x, y)."""
    kinds = ", ".join(f"{k} {masks.schema[k].dataType.simpleString()}" for k in keys)

    def each(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        p = np.array(rows, dtype=int)
        low = p.min(axis=0) - margin
        grid = np.zeros(p.max(axis=0) - low + 1 + margin, dtype=bool)
        grid[tuple((p - low).T)] = True
        for (i, j), d in np.ndenumerate(distance_from(grid)):
            yield *key, i + int(low[0]), j + int(low[1]), int(d)

    return by_group(masks.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")), list(keys), [], each, f"{kinds}, x int, y int, distance long")


def ends_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """The ends of a mask's skeleton."""
    if not mask.any():
        return []
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    part = mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    return [(int(rows[0]) + i, int(columns[0]) + j) for i, j in ends_and_branches(thin(part))[0]]


def ranks(mask: np.ndarray, lost: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """The order in which a body's new pixels come: near the body first, and near the end at which it lost most."""
    ends = ends_of(mask)
    if len(ends) < 2:
        return reached / WITHOUT_ENDS
    cells = np.indices(mask.shape)
    away = np.stack([np.hypot(cells[0] - x, cells[1] - y) for x, y in ends])
    nearest = away.argmin(axis=0)[lost]
    share = float((nearest == 0).sum() / len(nearest)) if np.isin(nearest, (0, 1)).any() else 0.5
    weight = np.minimum(away[0] * share, away[1] * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight > 0, reached / weight, np.inf)


def grow(mask: np.ndarray, free: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """``mask`` with up to n pixels of ``free`` more, one at a time.

    Each time the first n left, by rank (then rows, then columns), are looked at;
    the first that touches two neighbouring pixels of the mask joins it. Two of
    the eight places round a pixel are neighbours if they follow each other.
    """
    m = np.pad(mask, 1)
    ring = ring_of(m)  # views: they follow what is added
    todo = np.flatnonzero(free)
    todo = todo[np.argsort(rank.ravel()[todo], kind="stable")]
    while n > 0:
        touches = ring[-1] & ring[0]
        for a, b in zip(ring, ring[1:]):
            touches |= a & b
        fits = np.flatnonzero(touches.ravel()[todo[:n]])
        if not len(fits):
            break
        m[1 + todo[fits[0]] // mask.shape[1], 1 + todo[fits[0]] % mask.shape[1]] = True
        todo = np.delete(todo, fits[0])
        n -= 1
    return m[1:-1, 1:-1]


def carried(a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bodies' masks in the next frame, of which ``whole`` is the common mask."""
    kept = [a & whole, b & whole]
    lost = [a & ~whole, b & ~whole]
    away = [distance_from(k, FAR + 1) for k in kept]
    order = [ranks(k, gone, d) for k, gone, d in zip(kept, lost, away)]
    rest = whole & ~kept[0] & ~kept[1]
    own = [rest & (away[i] < NEAR) & (away[1 - i] > FAR) for i in (0, 1)]
    out = []
    for i in (0, 1):
        mask = kept[i] | own[i]
        out.append(grow(mask, whole & ~mask & (away[i] < REACH), order[i], int(lost[i].sum() - own[i].sum())))
    return out[0], out[1]


def pairing(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, margin: int) -> tuple[str, int, int]:
    """(verdict, pixels in common of a, x and b, y; of a, y and b, x): the pairing that leads by more than ``margin``, or open."""
    straight, crossed = int((a & x).sum() + (b & y).sum()), int((a & y).sum() + (b & x).sum())
    return ("straight" if straight > crossed + margin else "crossed" if crossed > straight + margin else "open"), straight, crossed


def aligned(masks: list[np.ndarray], border: int = 1) -> list[np.ndarray]:
    """Pixels (rows x, y) as boolean grids with one origin and size, and an empty border."""
    some = np.concatenate([m for m in masks if len(m)] or [np.zeros((1, 2), dtype=int)])
    low, high = some.min(axis=0) - border, some.max(axis=0) + border
    out = []
    for m in masks:
        grid = np.zeros(high - low + 1, dtype=bool)
        if len(m):
            grid[tuple((m - low).T)] = True
        out.append(grid)
    return out


def walk(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, frames: list[np.ndarray], margin: int = 10) -> tuple[str, int, int, int]:
    """(verdict, frames walked, pixels in common straight, crossed) of grids."""
    verdict = pairing(a, b, x, y, margin)
    steps = 0
    for whole in frames:
        if verdict[0] != "open":
            break
        a, b = carried(a, b, whole)
        steps += 1
        verdict = pairing(a, b, x, y, margin)
    return verdict[0], steps, verdict[1], verdict[2]


#: Bytes of masks whose outcome a worker remembers.
REMEMBERED = 1 << 24
_known: dict[tuple, tuple | None] = {}


def remembered(asked: tuple, answer: Callable[[], tuple | None]) -> tuple | None:
    """``answer()``, or what it was when it was last asked; asked: the roles, numbers of pixels and pixels, as bytes, and the settings."""
    if asked not in _known:
        if (len(_known) + 1) * len(asked[2]) > REMEMBERED:
            _known.clear()
        _known[asked] = answer()
    return _known[asked]


def unzipped(masks: DataFrame, collision: str = "collision", margin: int = 10, most: int = 50, laid: bool = False) -> DataFrame:
    """collision, verdict, steps, straight, crossed for rows (collision, role, frame, points: an array of struct<x, y>).

    Roles: a and b, the parents' last masks; x and y, the children's first; c, the
    masks of the collision in order of frame. straight: a goes on as x and b as y;
    crossed: a as y and b as x; open: neither pairing leads by more than
    ``margin`` pixels in any frame, nor after the last. Of more than ``most``
    frames every k-th is walked, k being the frames over ``most``, rounded down. A
    collision without one mask of each of a, b, x and y has no row; an empty or
    null mask of a frame counts as no frame. ``laid``: all masks of a collision are
    in one partition, so that they, far larger than the result, aren't shuffled.
    Masks that are the same but for their place are walked once in a while.
    """
    ddl = f"{collision} {masks.schema[collision].dataType.simpleString()}, verdict string, steps long, straight long, crossed long"
    schema = arrow_schema(ddl)
    points = F.coalesce(F.col("points"), F.array().cast("array<struct<x:int,y:int>>"))
    rows = masks.select(collision, "role", F.col("frame").cast("long").alias("frame"), F.transform(points, lambda p: p.x.cast("int")).alias("xs"), F.transform(points, lambda p: p.y.cast("int")).alias("ys"))

    def outcome(roles: list[str], lengths: np.ndarray, pixels: np.ndarray) -> tuple | None:
        parts = np.split(pixels, np.cumsum(lengths)[:-1])
        ends = {role: p for role, p in zip(roles, parts) if role != "c"}
        if set(ends) != {"a", "b", "x", "y"}:
            return None
        frames = [p for role, p in zip(roles, parts) if role == "c" and len(p)]
        frames = frames[:: max(1, len(frames) // most)]
        a, b, x, y, *rest = aligned([ends[r] for r in "abxy"] + frames)
        return walk(a, b, x, y, rest, margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, group in whole_groups(batches, collision):
            roles, (xs, ys) = group.column("role").to_pylist(), (group.column(c) for c in ("xs", "ys"))
            lengths = xs.value_lengths().to_numpy()
            pixels = np.stack([c.flatten().to_numpy() for c in (xs, ys)], axis=1).astype(int)
            pixels = pixels - pixels[:1]  # the outcome doesn't depend on the place
            verdict = remembered((tuple(roles), lengths.tobytes(), pixels.tobytes(), margin, most), lambda: outcome(roles, lengths, pixels))  # noqa: B023
            if verdict is not None:
                yield key, *verdict

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(batches)
        while part := list(islice(found, ROWS)):
            yield batch_of(part, schema)

    rows = rows if laid else dealt(rows, [collision])
    return rows.sortWithinPartitions(collision, "frame", "role").mapInArrow(result, ddl)


def outlines_of(df: DataFrame, outline: str, key: str, by: str = "frame", first: bool | None = None) -> DataFrame:
    """Rows with an outline: all of a node, or the first (or last, ``first`` false) of each."""
    some = df.where(F.col(outline).isNotNull() & (F.size(outline) > 0))
    if first is None:
        return some
    one = (F.min_by if first else F.max_by)(F.struct(*[c for c in df.columns if c != key]), by)
    return some.groupBy(key).agg(one.alias("_row")).select(key, "_row.*")


def aligned_outlines(df: DataFrame, outline: str, within: str, border: int = 1) -> DataFrame:
    """``df`` with shifted (the outline with the common corner of its group at ``border``), and width and height of the group's common grid."""
    bound = lambda f, c: f(F.transform(F.col(outline), lambda p: p[c]))
    box = df.groupBy(within).agg(*[g(bound(f, c)).alias(f"_{c}{n}") for c in ("x", "y") for n, f, g in (("0", F.array_min, F.min), ("1", F.array_max, F.max))])
    move = lambda p: F.struct((p.x - F.col("_x0") + border).alias("x"), (p.y - F.col("_y0") + border).alias("y"))
    size = lambda c: F.col(f"_{c}1") - F.col(f"_{c}0") + 1 + 2 * border
    out = df.join(box, within).withColumns({"shifted": F.transform(outline, move), "width": size("x"), "height": size("y")})
    return out.drop("_x0", "_x1", "_y0", "_y1")


def untangling(found: DataFrame, parents: Column, children: Column, collision: str = "collision") -> DataFrame:
    """collision, parent, child: the two pairs of each collision that isn't open; parents and children are arrays of two ids."""
    pair = lambda i, j: F.struct(F.get(parents, F.lit(i)).alias("parent"), F.get(children, F.lit(j)).alias("child"))
    pairs = F.when(F.col("verdict") == "straight", F.array(pair(0, 0), pair(1, 1))).when(F.col("verdict") == "crossed", F.array(pair(0, 1), pair(1, 0)))
    return found.select(collision, F.explode(pairs).alias("p")).select(collision, "p.*")
