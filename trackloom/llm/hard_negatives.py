"""Hard-negative mining by a dual-tree search over integer vectors.

Both trees have the same upper levels: a bucket of labels, then halving planes
fitted on at most ``SAMPLE`` rows, then chunks of bounded size (a large or hot
node is dealt over several by a hash of the id). Each chunk is halved further
down to leaves with an exact ball (centre and radius) round all of their rows,
and a leaf travels as one packed row. Pairs of an anchor chunk and a candidate
chunk whose inner products can't fall into the interval that the anchors look for
are dropped as a whole; the others are cells that tasks work on independently.
In a cell each anchor leaf visits candidate leaves by falling upper bound and
stops, for all its anchors at once, where the bound falls under what they have;
leaf pairs that remain are scored exactly, by one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from trackloom.llm.textbytes import give_back
from trackloom.llm.vectors import as_doubles, integer_rows, main_dimension
from trackloom.plans.lineage import stored

SAMPLE, MOST_DEPTH, LABEL_BUCKETS = 4096, 8, 16
CANDIDATE_CHUNK, CANDIDATE_LEAF = 65_536, 1024
ANCHOR_CHUNK, ANCHOR_LEAF = 8192, 256
FAR = 2**62
LEAF = "node int, chunk long, leaf int, n int, centre array<double>, radius double, chunk_centre array<double>, chunk_radius double, low long, high long, ids binary, labels binary, wanted binary, xs binary, width int"


def _clean(dimension: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = integer_rows(batch.column("vec"), dimension)
            at = pa.array(places)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("label").take(at), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], ["id", "label", "x"])

    return run


def halve(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction in which the rows differ most, and the median of their places along it."""
    centred = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    along = x @ vectors[:, -1]
    return vectors[:, -1], float(np.median(along))


def fit_planes(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, float]]:
    """The planes of a complete binary tree, parents before children."""
    planes, parts = [], [sample]
    while len(planes) < 2**depth - 1:
        rows = parts[len(planes)]
        direction, middle = halve(rows) if len(rows) else (np.zeros(sample.shape[1]), 0.0)
        planes.append((direction, middle))
        upper = rows @ direction > middle
        parts += [rows[~upper], rows[upper]]
    return planes


def place(x: np.ndarray, planes: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The number of each row's node on the lowest level."""
    at = np.zeros(len(x), dtype=np.int64)
    while len(x) and len(planes) > at[0]:
        sides = np.zeros(len(x), dtype=np.int64)
        for node in np.unique(at):
            mine = at == node
            sides[mine] = x[mine] @ planes[node][0] > planes[node][1]
        at = 2 * at + 1 + sides
    return at - len(planes)


def _placed(dimension: int, planes: list[tuple[np.ndarray, float]]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i8").reshape(-1, dimension)
            yield batch.append_column("below", pa.array(place(x.astype(np.float64), planes), pa.int32()))

    return run


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))


def split_leaves(x: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The places of the rows of each leaf: halves of halves until they have at most so many."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            yield rows
            continue
        order = rows[np.argsort(x[rows] @ halve(x[rows])[0], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def _leaves(dimension: int, most: int, n_wanted: int, bounds: tuple[int, int]) -> Callable:
    """Rows (node, chunk, id, label, x, wanted), sorted by chunk, as leaves."""

    def chunk_leaves(node: int, chunk: int, rows: list[tuple]) -> Iterator[tuple]:
        x = np.frombuffer(b"".join(r[2] for r in rows), dtype="<i8").reshape(-1, dimension)
        ids, labels = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
        wanted = np.full((len(rows), max(1, n_wanted)), -FAR, dtype=np.int64)
        for k, r in enumerate(rows):
            wanted[k, : len(r[3])] = r[3]
        low, high = windows(wanted, bounds) if n_wanted else (np.array([-FAR]), np.array([FAR]))
        fx = x.astype(np.float64)
        centre, radius = ball(fx)
        for leaf, at in enumerate(split_leaves(fx, most)):
            width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(x[at]).max() < 2 ** (8 * w - 1))
            own_centre, own_radius = ball(fx[at])
            yield (node, chunk, leaf, len(at), own_centre.tolist(), own_radius, centre.tolist(), radius, int(low.min()), int(high.max()), ids[at].tobytes(), labels[at].tobytes(), wanted[at].tobytes(), x[at].astype(f"<i{width}").tobytes(), width)

    names = [part.split()[0] for part in LEAF.split(", ")]

    def table(leaves: list[tuple]) -> pa.RecordBatch:
        vector, number = pa.list_(pa.float64()), pa.int32()
        kinds = [number, pa.int64(), number, number, vector, pa.float64(), vector, pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 4, number]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*leaves), kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("node", "chunk", "id", "label", "x", "wanted")]):
                if at != row[:2]:
                    if rows:
                        yield table(list(chunk_leaves(*at, rows)))
                    at, rows = row[:2], []
                rows.append(row[2:])
        if rows:
            yield table(list(chunk_leaves(*at, rows)))
        rows = []
        give_back()

    return run


def windows(wanted: np.ndarray, bounds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score with bounds[0] * wanted <= 100 * score <= bounds[1] * wanted; (FAR, -FAR) if there is none."""
    low, high = -((-bounds[0] * wanted) // 100), (bounds[1] * wanted) // 100
    none = (wanted == -FAR) | (low > high)
    return np.where(none, FAR, low), np.where(none, -FAR, high)


def _tree(rows: DataFrame, dimension: int, planes: list, chunk_rows: int, leaf_rows: int, n_wanted: int = 0, bounds: tuple[int, int] = (0, 0)) -> DataFrame:
    """The leaves of rows (id, label, x, wanted), as a stored table."""
    schema = StructType([*rows.schema.fields]).add("below", "integer")
    below = rows.mapInArrow(_placed(dimension, planes), schema) if planes else rows.withColumn("below", F.lit(0))
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")
    nodes = below.withColumn("node", bucket * (len(planes) + 1) + F.col("below")).drop("below")
    parts = nodes.groupBy("node").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).alias("parts"))  # at most LABEL_BUCKETS * 2**MOST_DEPTH rows
    salt = F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = nodes.join(F.broadcast(parts), "node").select("node", (F.shiftleft(F.col("node").cast("long"), 32) + salt).alias("chunk"), "id", "label", "x", "wanted")
    return stored(dealt.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_leaves(dimension, leaf_rows, n_wanted, bounds), LEAF), "leaves")


def _chunk_pairs(anchors: DataFrame, candidates: DataFrame, same_bucket: int) -> DataFrame:
    """a_chunk, c_chunk, whose balls allow inner products between the least and the largest that the anchors look for.

    same_bucket: the number of nodes of a label's bucket if both must be in one, else 0.
    """
    tops = [t.where("leaf = 0").select(F.col("node").alias(f"{k}_node"), F.col("chunk").alias(f"{k}_chunk"), F.col("chunk_centre").alias(f"{k}_centre"), F.col("chunk_radius").alias(f"{k}_radius"), "low", "high") for k, t in (("a", anchors), ("c", candidates))]
    a, c = tops[0], tops[1].drop("low", "high")
    nodes = sorted(r[0] for r in c.select("c_node").distinct().collect())  # at most LABEL_BUCKETS * 2**MOST_DEPTH
    pairs = a.withColumn("c_node", F.explode(F.array(*map(F.lit, nodes)).cast("array<int>")))
    if same_bucket:
        pairs = pairs.where(F.floor(F.col("a_node") / same_bucket) == F.floor(F.col("c_node") / same_bucket))
    pairs = pairs.join(c, "c_node")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    middle, slack = dot("a_centre", "c_centre"), F.col("a_radius") * F.sqrt(dot("c_centre", "c_centre")) + F.col("c_radius") * F.sqrt(dot("a_centre", "a_centre")) + F.col("a_radius") * F.col("c_radius")
    near = pairs.withColumn("m", middle).withColumn("s", slack * (1 + 1e-9) + F.abs(middle) * 1e-9 + 1)
    return near.where("m + s >= low and m - s <= high").select("a_chunk", "c_chunk")


class Leaf:
    def __init__(self, row: dict):
        self.n, self.width, self.centre, self.radius = row["n"], row["width"], np.array(row["centre"]), row["radius"]
        self.ids, self.labels = (np.frombuffer(row[k], dtype="<i8") for k in ("ids", "labels"))
        self.wanted, self.xs = row["wanted"], row["xs"]

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.xs, dtype=f"<i{self.width}").reshape(self.n, -1)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(c).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most >= FAR:
        raise OverflowError("inner products don't fit 62 bits")
    return a.astype(np.int64) @ c.astype(np.int64).T


def best_of_leaf(a: Leaf, candidates: list[Leaf], k: int, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor's place, window, id, score): for each anchor and window (low, high: anchors x windows) its k best candidates.

    same: of the anchor's label and with another id, or else of another label.
    """
    n, w = low.shape
    x = a.matrix()
    kth, kth_id = np.full((n, w), -FAR), np.full((n, w), np.iinfo(np.int64).max)
    key, ids, scores = (np.zeros(0, dtype=np.int64) for _ in range(3))
    centres, radii = np.array([c.centre for c in candidates]), np.array([c.radius for c in candidates])
    middle = centres @ a.centre
    slack = (a.radius * np.linalg.norm(centres, axis=1) + radii * np.linalg.norm(a.centre) + a.radius * radii) * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1
    upper, lower = middle + slack, middle - slack
    for j in np.argsort(-upper, kind="stable"):
        least = np.maximum(low, kth).min(axis=1)
        if upper[j] < least.min():
            break
        if lower[j] > high.max():
            continue
        c = candidates[j]
        found = products(x, c.matrix())
        fits = (found >= least[:, None]) & (found <= high.max(axis=1)[:, None])
        alike = a.labels[:, None] == c.labels
        fits &= alike & (a.ids[:, None] != c.ids) if same else ~alike
        if w == 1 and c.n > k:  # only the k best of the leaf can stay
            fits &= found >= np.partition(np.where(fits, found, -FAR), c.n - k, axis=1)[:, c.n - k, None]
        r, col = np.nonzero(fits)
        if not len(r):
            continue
        s, i = found[r, col], c.ids[col]
        new = [(q, (s >= low[r, q]) & (s <= high[r, q]) & ((s > kth[r, q]) | ((s == kth[r, q]) & (i < kth_id[r, q])))) for q in range(w)]
        key = np.concatenate([key, *[r[m] * w + q for q, m in new]])
        ids = np.concatenate([ids, *[i[m] for _, m in new]])
        scores = np.concatenate([scores, *[s[m] for _, m in new]])
        order = np.lexsort((ids, -scores, key))
        key, ids, scores = key[order], ids[order], scores[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        rank = np.arange(len(key)) - np.repeat(heads, np.diff(np.r_[heads, len(key)]))
        stays = rank < k
        key, ids, scores, full = key[stays], ids[stays], scores[stays], rank[stays] == k - 1
        kth.ravel()[key[full]], kth_id.ravel()[key[full]] = scores[full], ids[full]
    return key // w, key % w, ids, scores


def _cells(k: int, n_wanted: int, bounds: tuple[int, int], same: bool) -> Callable:
    """Leaves (kind 0: anchors, 1: candidates), sorted by cell and kind, as the best candidates of each anchor in its cell."""

    def cell(sides: tuple[list[Leaf], list[Leaf]]) -> Iterator[pa.RecordBatch]:
        for a in sides[0] if sides[1] else []:
            if n_wanted:
                low, high = windows(np.frombuffer(a.wanted, dtype="<i8").reshape(a.n, -1), bounds)
            else:
                low, high = np.full((a.n, 1), -FAR), np.full((a.n, 1), FAR)
            rows, nth, ids, scores = best_of_leaf(a, sides[1], k, low, high, same)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[rows]), pa.array(nth.astype(np.int32)), pa.array(ids), pa.array(scores)], ["anchor", "nth", "id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["a_chunk"], row["c_chunk"]):
                    yield from cell(sides)
                    at, sides = (row["a_chunk"], row["c_chunk"]), ([], [])
                sides[row["kind"]].append(Leaf(row))
        yield from cell(sides)
        sides = ()
        give_back()

    return run


def _searched(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int, n_wanted: int, bounds: tuple[int, int], same: bool) -> DataFrame:
    """anchor, nth, id, score, rank: for each anchor and window the k best candidates of all cells."""
    fields = ["leaf", "n", "centre", "radius", "ids", "labels", "wanted", "xs", "width"]
    left = anchors.withColumnRenamed("chunk", "a_chunk").join(pairs, "a_chunk").select("a_chunk", "c_chunk", F.lit(0).alias("kind"), *fields)
    right = candidates.withColumnRenamed("chunk", "c_chunk").join(pairs, "c_chunk").select("a_chunk", "c_chunk", F.lit(1).alias("kind"), *fields)
    cells = left.union(right).repartition("a_chunk", "c_chunk").sortWithinPartitions("a_chunk", "c_chunk", "kind", "leaf")
    found = cells.mapInArrow(_cells(k, n_wanted, bounds, same), "anchor long, nth int, id long, score long")
    best = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame,
    is_anchor: Callable[[Column], Column],
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    bounds: tuple[int, int] = (50, 95),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(256 * vector) of two rows; higher ones
    come first, then smaller ids. The anchors (``is_anchor`` of the id) have as
    positives their first ``positives`` other rows of the same label; for each,
    the first ``negatives`` rows of other labels of which the score lies between
    bounds[0] and bounds[1] per cent of the positive's are returned.

    Ids and labels are integers. Rows with a null id, label or vector, with a null
    or non-finite entry or one of 2**44 or more, and vectors of another length
    than most take no part; of rows with one id that with the smallest label, then
    the smallest bytes of its vector, does. Equal vectors are rows like others.
    Scores of 2**62 or more raise an error. An empty table gives an empty result;
    extra columns are ignored.
    """
    d = main_dimension(df, vec_col)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), as_doubles(vec_col).alias("vec")).where("id is not null and label is not null and vec is not null")
    rows = rows.mapInArrow(_clean(d), "id long, label long, x binary").groupBy("id").agg(F.min(F.struct("label", "x")).alias("one"))
    rows = stored(rows.select("id", "one.label", "one.x", F.array().cast("array<long>").alias("wanted")), "vectors")
    n = rows.count()
    depth = min(MOST_DEPTH, max(0, int(np.log2(max(1, n / (CANDIDATE_CHUNK * LABEL_BUCKETS))))))
    planes: list = []
    if depth:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()
        planes = fit_planes(np.frombuffer(b"".join(bytes(r.x) for r in sample), dtype="<i8").reshape(-1, d).astype(np.float64), depth)
    candidates = _tree(rows, d, planes, CANDIDATE_CHUNK, CANDIDATE_LEAF)

    chosen = rows.where(is_anchor(F.col("id")))
    anchors = _tree(chosen, d, planes, ANCHOR_CHUNK, ANCHOR_LEAF)
    first = _searched(anchors, candidates, _chunk_pairs(anchors, candidates, len(planes) + 1), positives, 0, (0, 0), True)
    first = stored(first, "positives")
    scores = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))  # at most so many as positives
    chosen = chosen.drop("wanted").join(scores.select(F.col("anchor").alias("id"), F.col("found.score").alias("wanted")), "id")
    anchors = _tree(chosen.select("id", "label", "x", "wanted"), d, planes, ANCHOR_CHUNK, ANCHOR_LEAF, positives, bounds)
    second = _searched(anchors, candidates, _chunk_pairs(anchors, candidates, 0), negatives, positives, bounds, False)
    ranked = first.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.join(ranked, ["anchor", "nth"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
