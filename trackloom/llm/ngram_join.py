"""Near duplicates: pairs of texts whose sets of word n-grams have a Jaccard similarity of at least 0.8.

Method: MinHash banding. ``choose_bands`` takes the most rows a band for which
the wanted recall at the threshold is met with ``max_hashes`` hash functions.
Texts are shuffled on their band hashes. The smallest text of a band bucket is
its hub; buckets with one hub are verified together, so texts that share many
bands travel once or a few times and not once a band, and nothing is compared
that doesn't meet at a hub. Pairs are verified on the full n-gram sets, each
pair at the least of its common hubs only. A hub's texts are worked off in pairs
of blocks of bounded size, each a row group of its own, so a huge bucket spreads
over many tasks; links are counted there and only a spanning forest of them
leaves a task.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Texts with equal words
are copies: one of them is verified for all. A text of fewer words than n is one
n-gram. Nulls and edge cases: a null text, or one without words, has no n-grams
and links to nothing, each a class of its own; a null id counts as larger than
any other; repeated rows and rows with one id are classified by their own text;
ids keep their type; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from trackloom.llm.textbytes import LOWER_WORDS, encode, give_back, hash_spans, join_words, mix, ngram_hashes, ranges, sliced
from trackloom.operators.components import connected_components
from trackloom.operators.hotkeys import attach
from trackloom.plans.lineage import cut, stored


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): of the choices that find a pair at the threshold with probability ``recall``, the one with the most rows."""
    for rows in range(max_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("max_hashes is too small for this recall")


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, and for each text the number before its own (with the total)."""
    buf, starts, ends, bounds = join_words(texts, LOWER_WORDS)
    words, sizes = hash_spans(buf, starts, ends), np.diff(bounds)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = ngram_hashes(words, n)[ranges(bounds[:-1], np.where(sizes >= n, counts, 0))] if len(words) >= n else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    after = np.concatenate([[0], np.cumsum(counts)])
    if len(short):
        own = [int(ngram_hashes(words[bounds[i] : bounds[i + 1]], int(sizes[i]))[0]) for i in short]
        long_before = np.concatenate([[0], np.cumsum(np.where(sizes >= n, counts, 0))])
        out = np.insert(out, long_before[short], np.array(own, dtype=np.uint64))
    return out, after


def word_key(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.translate(LOWER_WORDS).split()), digest_size=16).digest()


def _sketch(n: int, bands: int, rows: int) -> Callable:
    rng = np.random.default_rng(20_240_601)
    flips = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    factors = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            hashes, bounds = shingles(texts, n)
            some = np.flatnonzero(np.diff(bounds))
            keys: list = [None] * len(texts)
            found: list = [None] * len(texts)
            if len(some):
                x, heads = (hashes >> np.uint64(32)).astype(np.uint32), bounds[some]
                tmp = np.empty_like(x)
                band_hashes = np.zeros((bands, len(some)), dtype=np.uint64)
                for k in range(bands * rows):
                    np.bitwise_xor(x, flips[k], out=tmp)
                    np.multiply(tmp, factors[k], out=tmp)
                    b = k // rows
                    band_hashes[b] = band_hashes[b] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(tmp, heads) + np.uint64(b + 1)
                band_hashes = mix(band_hashes).view(np.int64).T
                for j, i in enumerate(some.tolist()):
                    keys[i], found[i] = word_key(texts[i]), band_hashes[j]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(keys, pa.binary()), pa.array(np.diff(bounds), pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["row", "text", "key", "n_grams", "bands"],
            )

    return run


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        dense = np.zeros((len(sets), 2048), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[left] @ dense[right].T
    return np.rint(out).astype(np.int64)


def links_in_block(sets: list[np.ndarray], side: np.ndarray, threshold: float, elsewhere: list[np.ndarray]) -> np.ndarray:
    """A symmetric matrix: which pairs are similar?

    side: 0 or 1; with both sides, only pairs across count. elsewhere: pairs
    that have a number in common there are left out.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
    out = np.zeros((len(sets), len(sets)), dtype=bool)
    if not len(left):
        return out
    both = _intersections(sets, left, right)
    union = sizes[left][:, None] + sizes[right] - both
    alike = both >= threshold * union - 1e-9
    if any(len(e) for e in elsewhere):
        alike &= _intersections(elsewhere, left, right) == 0
    out[np.ix_(left, right)] = alike
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _verify(n: int, threshold: float) -> Callable:
    def results(hub: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        grams, bounds = shingles([r[2] for r in rows], n)
        sets = [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:])]
        smaller = [np.array([h for h in r[3] if h < hub], dtype=np.int64) for r in rows]
        linked = links_in_block(sets, np.array([r[1] for r in rows]), threshold, smaller)
        count = linked.sum(axis=1)
        nodes = np.array([r[0] for r in rows], dtype=np.int64)
        root = nodes.copy()
        while True:
            low = np.minimum(root, np.where(linked, root, nodes.max()).min(axis=1))
            if (low == root).all():
                break
            root = low
        some = count > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(count[some]), pa.array(root[some])], ["node", "n_links", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hub", "i", "j", "node", "block", "hubs")]
            for k, (hub, i, j, node, block, hubs) in enumerate(zip(*columns)):
                if group != (hub, i, j):
                    if group:
                        yield from results(group[0], rows)
                    group, rows = (hub, i, j), []
                rows.append((node, int(block != i), encode([batch.column("text")[k].as_py()])[0], hubs))
        if group:
            yield from results(group[0], rows)
        rows = []
        give_back()

    return run


def _classified(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    max_hashes: int = 224,
    block_rows: int = 128,
    block_grams: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (id, text, row): the stored table row_id, id, text_hash, key, text, row; and for each key copy_id, class_id, n_links, first (the row_id of its class to keep)."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select(F.struct("id", F.col("row").alias("row")).alias("row"), "text")
    sketch = packed.mapInArrow(_sketch(n, bands, rows), StructType([*packed.schema.fields]).add("key", "binary").add("n_grams", "long").add("bands", ArrayType(LongType())))
    sketch = sketch.select(F.monotonically_increasing_id().alias("row_id"), "row.id", F.xxhash64("text").alias("text_hash"), "key", "n_grams", "bands", "text", "row.row")
    sketch = stored(sketch, "sketches")
    one = F.struct(F.isnull("id"), "id", "text_hash", "row_id")  # the row to keep of equal ones: least id, nulls last
    classes = sketch.where("key is not null").groupBy("key").agg(F.min(one).alias("one"), F.min("id").alias("copy_id"), F.min(F.struct("row_id", "n_grams", "bands")).alias("rep"))
    classes = stored(classes.select("key", "copy_id", "one", F.col("rep.row_id").alias("node"), "rep.n_grams", "rep.bands"), "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = attach(banded, buckets, ["band"], ["node"]).select("hub", "node").distinct()
    lists = members.groupBy("node").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))  # one a band at most
    members = stored(members.join(lists, "node").join(classes.select("node", "n_grams").hint("merge"), "node"), "members")
    sizes = members.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / F.lit(block_rows), F.sum("n_grams") / F.lit(block_grams))).alias("blocks"))
    placed = attach(members, sizes, ["hub"], ["node"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    own = sketch.select(F.col("row_id").alias("node"), "text").hint("merge")  # both sides grow with the input: never broadcast
    texts = placed.join(own, "node").select("hub", "hubs", "node", "block", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = texts.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "hubs", "text")
    nth = F.col("j") * (F.col("j") + 1) / 2 + F.col("i")  # the pairs of one hub go to one task after the other
    dealt = pairs.repartitionById(parts, F.pmod(F.xxhash64("hub") + nth.cast("long"), F.lit(parts)).cast("int"))
    found = dealt.sortWithinPartitions("hub", "i", "j").mapInArrow(_verify(n, threshold), "node long, n_links long, root long")
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    joined = connected_components(found, "node", "root")

    merged = classes.select("key", "node", "copy_id", "one").hint("merge").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = merged.groupBy("component").agg(F.min("copy_id").alias("class_id"), F.min("one").getField("row_id").alias("first"))
    named = attach(merged, first, ["component"], ["node"]).select("key", "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "first")
    return sketch, cut(named)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: the id column, text_hash, class_id, copy_id, n_links.

    class_id: the smallest id of the texts that are linked to this one, directly
    or through others. copy_id: the smallest id of those with the same words.
    n_links: the number of different texts (by their words) that are similar to
    this one. text_hash: xxhash64 of the text. Options: n, threshold, recall,
    max_hashes, and block_rows and block_grams, the size of a block.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("row"))
    sketch, named = _classified(docs, **options)
    out = attach(sketch.select("row_id", "id", "text_hash", "key"), named, ["key"], ["row_id"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("id"))  # no words
    return out.select(F.col("id").alias(id_col), "text_hash", F.coalesce("class_id", own).alias("class_id"), F.coalesce("copy_id", own).alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, of equal or null ids that with the smallest text hash, of repeated rows one.

    Rows whose text has no words are all kept.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{x}`") for x in names if x != text_col] or [F.lit(0).alias("none")])
    packed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    sketch, named = _classified(packed, **options)
    kept = named.select(F.col("first").alias("row_id")).distinct()
    rows = sketch.where("key is not null").join(kept.hint("merge"), "row_id", "left_semi").unionByName(sketch.where("key is null"))
    return rows.select(*[F.col("text").alias(x) if x == text_col else F.col("row").getField(x).alias(x) for x in names])
