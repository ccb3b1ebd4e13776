"""Exact removal of passages that another document had first.

Method: super-k-mer partitioning. A window is ``window`` consecutive words; its
minimiser is the smallest hash of ``gram`` consecutive words inside it. Runs of
windows with one minimiser travel as a single packed string to the bucket of
that minimiser, where the windows are sorted, compared word for word and
counted. All copies of a window meet in one bucket, so the result is exact.

A minimiser that is much more frequent than others would make one large bucket.
A sample of the rows tells which ones are (it only decides where windows meet,
not what is found): their windows are dealt over all buckets by a hash of the
whole window, which equal windows share too. Copies meet before the shuffle: of
equal packed strings that a task has at hand only those of the smallest document
travel, since all their windows are repeats in the others; a passage that a
third of all documents share thus sends one string a flush, not one a document.
What goes to the same bucket shares one zstd block. A bucket that is larger than
``max_bytes`` all the same is worked off in rounds, each holding the windows of
one residue of their hash only.

Nulls and edge cases: ids are integers; a null or empty text has no words; a
null id counts as larger than any other; rows with equal ids never remove each
other's words, and are told apart by their number in a stored copy of the table;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.lineage import stored
from trackloom.llm.textbytes import SPACE_WORDS, find_words, give_back, hash_spans, join_words, mix, ngram_hashes, ranges, sliced

NO_ID = 2**63 - 1
MAX_WINDOWS = 256
FLUSH_BYTES = 24 << 20
MAX_PARTS = 100_000  # shuffle partitions; beyond that a task works off more buckets, one after the other


def _pack(doc: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, text: bytes) -> bytes:
    """doc: what decides who is first; key: which row it is (often the same)."""
    raw = np.array([len(doc)], dtype=np.int64).tobytes() + np.diff(doc, prepend=0).tobytes() + (key - doc).tobytes() + at.astype(np.int32).tobytes() + n.astype(np.int32).tobytes() + text
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, k, at))
        at += k * np.dtype(kind).itemsize
    doc = np.cumsum(out[0])
    return doc, out[1] + doc, *out[2:], raw[at:]


def super_kmers(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, minimiser) of each run of windows with one minimiser.

    ``bounds``: for each text the number of words before it, and the total.
    """
    sizes = np.diff(bounds)
    starts = ranges(bounds[:-1], np.maximum(sizes - window + 1, 0))
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    least, span, width = ngram_hashes(hashes, gram), 1, window - gram + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    least = least[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) != 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    if count.max() > MAX_WINDOWS:  # one word over and over
        pieces = -(-count // MAX_WINDOWS)
        nth = ranges(np.zeros(len(first), dtype=np.int64), pieces)
        first, count = np.repeat(first, pieces) + nth * MAX_WINDOWS, np.minimum(np.repeat(count, pieces) - nth * MAX_WINDOWS, MAX_WINDOWS)
    return starts[first], count + window - 1, least[first]


class _Numbers(dict):
    """packed string -> number, in order of appearance"""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


COLUMNS = ["bucket", "block", "key", "spans"]


def _rows(bucket: np.ndarray, block: list | None, key: np.ndarray | None = None, spans: list | None = None) -> pa.RecordBatch:
    none = [None] * len(bucket)
    values = (bucket, none if block is None else block, none if key is None else key, none if spans is None else spans)
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], COLUMNS)


def _by_text(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(key, packed pairs of word positions) of each text, from spans in any order; those that meet are joined."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    row = np.ones(len(key), dtype=bool)
    row[1:] = key[1:] != key[:-1]
    text = np.cumsum(row) << 32
    run = row.copy()
    run[1:] |= (start + text)[1:] > np.maximum.accumulate(end + text)[:-1]
    first = np.flatnonzero(run)
    pairs = np.stack([start[first], np.maximum.reduceat(end, first)], axis=1).astype(np.int32)
    heads = np.flatnonzero(row[first])
    cuts = np.append(heads, len(first))
    return key[first[heads]], [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _emit(parts: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks for the buckets, and what is known at once: of equal packed strings of a task only those of the smallest document travel, for all their windows in others are repeats.

    parts: (bucket, doc, key, position, words, packed strings) per slice of texts.
    """
    bucket, doc, key, at, n = (np.concatenate([p[k] for p in parts]) for k in range(5))
    strings = [s for p in parts for s in p[5]]
    number = np.array(list(map(_Numbers().__getitem__, strings)), dtype=np.int64)
    smallest = np.full(int(number.max()) + 1, NO_ID, dtype=np.int64)
    np.minimum.at(smallest, number, doc)
    late = np.flatnonzero(doc > smallest[number])
    if len(late):
        found = _by_text(key[late], at[late], at[late] + n[late])
        yield _rows(found[0] % buckets, None, *found)
    order = np.flatnonzero(doc <= smallest[number])
    order = order[np.argsort(bucket[order], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    blocks = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i = order[a:b]
        blocks.append(_pack(doc[i], key[i], at[i], n[i], b" ".join([strings[k] for k in i.tolist()])))
    yield _rows(bucket[order[cuts[:-1]]], blocks)


def _split(texts: list[bytes], window: int, gram: int) -> tuple:
    """(text, word starts, word ends, word hashes, bounds, first word, number of words, minimiser) of the super-k-mers of some texts."""
    texts = [b" ".join(t.split()) for t in texts]  # bytes.split() knows just these spaces
    buf, starts, ends, bounds = join_words(texts, SPACE_WORDS)
    hashes = hash_spans(buf, starts, ends)
    return buf, starts, ends, hashes, bounds, *super_kmers(hashes, bounds, window, gram)


def _sizes(window: int, gram: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in sliced(batches):
            _, starts, ends, _, _, first, count, least = _split(texts, window, gram)
            keys, place = np.unique(least, return_inverse=True)
            sizes = np.bincount(place, ends[first + count - 1] - starts[first], minlength=len(keys)) if len(keys) else keys
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes.astype(np.int64))], ["minimiser", "size"])

    return run


def hot_minimisers(docs: DataFrame, window: int, gram: int, hot_bytes: int, share: float, most: int = 1 << 20) -> np.ndarray:
    """Minimisers with more than about ``hot_bytes`` of packed strings, sorted; from a sample, and at most the ``most`` largest."""
    sizes = docs.select("text").sample(share, 7).mapInArrow(_sizes(window, gram), "minimiser long, size long")
    hot = sizes.groupBy("minimiser").agg(F.sum("size").alias("size")).where(F.col("size") > hot_bytes * share).orderBy(F.desc("size"), "minimiser").limit(most)
    return np.sort(hot.select("minimiser").toArrow().column(0).to_numpy().view(np.uint64))  # at most 8 bytes * most


def _spread(window: int, gram: int, buckets: int, hot) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, frequent = [], 0, hot.value
        for rows, texts in sliced(batches):
            buf, starts, ends, hashes, bounds, first, count, least = _split(texts, window, gram)
            if not len(first):
                continue
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)
                is_hot = frequent[at] == least
                alone = ranges(first[is_hot], count[is_hot] - window + 1)  # their windows one by one
                first, count = np.concatenate([first[~is_hot], alone]), np.concatenate([count[~is_hot], np.full(len(alone), window)])
                least = np.concatenate([least[~is_hot], ngram_hashes(hashes, window)[alone]])
            text = np.searchsorted(bounds, first, side="right") - 1
            doc, key = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[text] for c in ("doc_id", "key"))
            bucket = (mix(least ^ np.uint64(0x5BD1E995)) % np.uint64(buckets)).astype(np.int64)
            s, e = starts[first], ends[first + count - 1]
            parts.append((bucket, doc, key, first - bounds[text], count, [buf[x:y] for x, y in zip(s.tolist(), e.tolist())]))
            size += int((e - s).sum())
            if size >= FLUSH_BYTES:
                yield from _emit(parts, buckets)
                parts, size = [], 0
        if parts:
            yield from _emit(parts, buckets)

    return run


def _residue(blocks: list[bytes], window: int, rounds: int, residue: int) -> tuple:
    """(hash, doc, key, position, start, end, number of its text) of the windows of one residue, and the texts."""
    kept, texts = [], []
    for block in blocks:
        doc, row, at, n, text = _unpack(block)
        starts, ends = find_words(text)
        hashes = ngram_hashes(hash_spans(text, starts, ends), window)
        bounds = np.concatenate([[0], np.cumsum(n)])
        own = np.repeat(np.arange(len(n)), n - window + 1)
        first = ranges(bounds[:-1], n - window + 1)
        key = hashes[first]
        if rounds > 1:
            mine = key % np.uint64(rounds) == residue
            own, first, key = own[mine], first[mine], key[mine]
        s, e = starts[first], ends[first + window - 1]
        position = at[own] + (first - bounds[own])
        if rounds > 1:  # hold the bytes of these windows only
            text = np.frombuffer(text, dtype=np.uint8)[ranges(s, e - s)].tobytes()
            e = np.cumsum(e - s)
            s = np.concatenate([[0], e[:-1]]) if len(e) else e
        kept.append((key, doc[own], row[own], position, s, e, np.full(len(key), len(texts))))
        texts.append(text)
    return *(np.concatenate(x) for x in zip(*kept)), texts


def repeated_windows(blocks: list[bytes], window: int, max_bytes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, word position) of each window of a bucket whose words a smaller doc_id has too."""
    size = sum(int.from_bytes(b[:8], "little") for b in blocks)
    rounds = 1 if size <= max_bytes else -(-5 * size // max_bytes)  # a word is in about five windows of a packed string
    found = []
    for residue in range(rounds):
        key, doc, row, at, s, e, where, texts = _residue(blocks, window, rounds, residue)
        order = np.lexsort((doc, key))
        key = key[order]
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[1:] == key[:-1]
        some = same[:-1] | same[1:]  # a window met once can't be a repeat
        order, key = order[some], key[some]
        if not len(order):
            continue
        # Equal hashes may still hold different words: sort those by their words too.
        slices = [texts[w][x:y] for w, x, y in zip(where[order].tolist(), s[order].tolist(), e[order].tolist())]
        hashed = np.concatenate([[True], key[1:] != key[:-1]])
        differs = np.fromiter((a != b for a, b in zip(slices, slices[1:])), dtype=bool, count=len(slices) - 1)
        if (differs & ~hashed[1:]).any():
            again = sorted(range(len(order)), key=lambda i: (key[i], slices[i], doc[order[i]]))
            order, slices = order[again], [slices[i] for i in again]
            differs = np.fromiter((a != b for a, b in zip(slices, slices[1:])), dtype=bool, count=len(slices) - 1)
        new = np.concatenate([[True], differs | hashed[1:]])
        smallest = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]  # sorted by doc within equal words
        late = order[doc[order] > smallest]
        found.append((row[late], at[late]))
    return found


def _count(window: int, max_bytes: int) -> Callable:
    def ranges_of(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = repeated_windows(blocks, window, max_bytes)
        if not found:
            return
        key, at = (np.concatenate(x) for x in zip(*found))
        if not len(key):
            return
        key, spans = _by_text(key, at, at + window)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(spans, pa.binary())], COLUMNS[2:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks = None, []
        for batch in batches:
            known = pa.compute.is_null(batch.column("block"))
            yield batch.select(COLUMNS[2:]).filter(known)
            batch = batch.filter(pa.compute.invert(known))
            for b, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if b != bucket and blocks:
                    yield from ranges_of(blocks)
                    blocks = []
                bucket = b
                blocks.append(block)
        if blocks:
            yield from ranges_of(blocks)
        blocks = []
        give_back()

    return run


def removed_words(spans: list[bytes] | None, n_words: int) -> np.ndarray:
    """A flag for each word of a text: is it removed?"""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    for pairs in spans or ():
        pairs = np.frombuffer(pairs, np.int32).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_spans(docs: DataFrame, window: int = 13, gram: int = 3, part_bytes: int = 24 << 20, bucket_bytes: int = 6 << 20, max_bytes: int = 16 << 20, sample_share: float = 1 / 64) -> DataFrame:
    """key, spans (array of packed int32 pairs of word positions) of each row of ``docs`` (doc_id, key, text) with repeats."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(-(-3 * total // part_bytes), MAX_PARTS))  # a word is in about three packed strings
    buckets = max(parts, -(-3 * total // bucket_bytes))
    hot = spark.sparkContext.broadcast(hot_minimisers(docs, window, gram, max_bytes, sample_share))
    blocks = docs.mapInArrow(_spread(window, gram, buckets, hot), "bucket long, block binary, key long, spans binary")
    dealt = blocks.repartitionById(parts, (F.col("bucket") % parts).cast("int"))  # as many buckets for each task
    spans = dealt.sortWithinPartitions("bucket").mapInArrow(_count(window, max_bytes), "key long, spans binary")
    return spans.groupBy("key").agg(F.collect_list("spans").alias("spans"))


def with_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """row (a struct of the columns of ``docs`` but the text), text, spans; the rows move once, the spans are a small part of them.

    A row's key is its id where all ids differ, else its number in a stored copy of the table.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns if n != text_col] or [F.lit(0).alias("none")])
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("key", F.col("doc_id"))
    else:
        rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
    spans = repeated_spans(rows.select("doc_id", "key", "text"), **options)
    return rows.select("key", "text", "row").join(spans, "key", "left").select("row", "text", "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every repeated passage cut out of its texts (a removed word goes with the space after it).

    All rows and columns stay; a text without repeats stays as it is, a null text null.
    """
    names = docs.columns
    found = with_spans(docs, id_col, text_col, **options)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    starts, _ = find_words(raw.translate(SPACE_WORDS))
                    gone = removed_words(spans, len(starts))
                    edges = np.append(starts, len(raw))
                    texts[i] = (raw[: edges[0]] + b"".join(raw[edges[a] : edges[a + 1]] for a in np.flatnonzero(~gone).tolist())).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = found.mapInArrow(cut, found.select("row", "text").schema)
    return out.select(*[F.col("text").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names])


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of each row of ``docs``."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts, rows.column("spans").to_pylist()):
                words = text.split()
                gone = removed_words(spans, len(words)) if spans else np.zeros(0, dtype=bool)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                if n_removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(docs, "doc_id", "text", **options).select("row.doc_id", "text", "spans")
    return found.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
