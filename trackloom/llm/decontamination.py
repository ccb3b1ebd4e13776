"""Benchmark decontamination: which words of a document stand in a benchmark item?

Method: one Aho-Corasick automaton over the windows (``window`` consecutive
words; a shorter item is one window) of all items. A text is normalised to one
symbol a word (A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``;
words that no item has share a symbol) and scanned once; a match's offset is a
word number, which leads to the place in the original text.

The items are broadcast. Beyond ``max_bytes`` of text they are cut into shards
(a long item into pieces that share ``window`` - 1 words), and the texts, in a
stored copy of the table, are scanned once a shard, so no task or driver ever
holds more than one shard and its automaton; what was found is written after
each scan and joined to the rows by their number at the end.

Nulls and edge cases: a null text has no words; items without words match
nothing; an item without id counts for hits but can't be named; items that share
a window are all named; repeated rows get equal results; with an empty benchmark
nothing is hit; document ids keep their type.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.textbytes import LOWER_WORDS, encode, find_words, sliced, worker_model
from trackloom.plans.lineage import cut, stored

OTHER = "\x00"
RESULT = "id {}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"


class _Symbols(dict):
    """word -> its symbol; words of no item -> OTHER."""

    def __missing__(self, word: bytes) -> str:
        return OTHER


class WindowAutomaton:
    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.symbols = _Symbols()
        windows: dict[str, set[str]] = {}
        for item, text in items:
            words = encode([text])[0].translate(LOWER_WORDS).split()
            for w in words:
                if w not in self.symbols:
                    n = len(self.symbols) + 1
                    self.symbols[w] = chr(n + (n >= 0xD800) * 0x800)  # no surrogates
            line = "".join(map(self.symbols.__getitem__, words))
            for i in range(max(1, len(line) - window + 1) if line else 0):
                windows.setdefault(line[i : i + window], set()).update([item] if item is not None else ())
        self.automaton = ahocorasick.Automaton()
        for line, found in windows.items():
            self.automaton.add_word(line, (len(line), tuple(found)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, end) of each occurrence, and the items."""
        spans, items = [], set()
        if not self.empty and words:
            for end, (length, found) in self.automaton.iter("".join(map(self.symbols.__getitem__, words))):
                spans.append((end + 1 - length, end + 1))
                items.update(found)
        return spans, items


def _automaton(shard: bytes, window: int) -> WindowAutomaton:
    return worker_model(shard + str(window).encode(), lambda: WindowAutomaton(pickle.loads(shard), window))


def _pieces(window: int, most: int) -> Callable:
    """Cuts items of more than ``most`` bytes where words end; neighbours share the window - 1 words that no window may lose."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, raw in zip(batch.column("item").to_pylist(), encode(batch.column("text").to_pylist())):
                starts, ends = find_words(raw.translate(LOWER_WORDS)) if len(raw) > most else ([], [])
                low = 0
                while low < len(starts):
                    high = max(low + window, int(np.searchsorted(ends, starts[low] + most)))
                    items.append(item)
                    texts.append(raw[starts[low] : ends[min(high, len(ends)) - 1]].decode())
                    low = high - window + 1 if high < len(starts) else len(starts)
                if len(raw) <= most:
                    items.append(item)
                    texts.append(raw.decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return run


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_bytes: int) -> list[Callable]:
    """Functions that broadcast about max_bytes each."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // max_bytes)
    if n > 1:
        items = cut(items.mapInArrow(_pieces(window, max_bytes // 4), "item string, text string"))
    context = benchmark.sparkSession.sparkContext
    shard = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return [lambda k=k: context.broadcast(pickle.dumps(sorted(map(tuple, shard(k).collect()), key=str))) for k in range(n)]


def _hits(shard, window: int) -> Callable:
    """row_id, hits (packed int32 word pairs), items of the rows that a shard finds something in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shard.value, window)
        for rows, texts in sliced(batches):
            found = [(k, *automaton.scan(t.translate(LOWER_WORDS).split())) for k, t in enumerate(texts)]
            found = [(k, np.array(spans, dtype=np.int32).tobytes(), sorted(items)) for k, spans, items in found if spans]
            which, hits, items = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([rows.column("row_id").take(pa.array(which, pa.int64())), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["row_id", "hits", "items"])

    return run


def _covered(hits: bytes, n_words: int) -> np.ndarray:
    pairs = np.frombuffer(hits, dtype=np.int32).reshape(-1, 2)
    edge = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _found(shard, window: int, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes], list[list[str]]]]:
    """(rows, texts, hits, items): from the one shard, or what the scans of several found."""
    automaton = _automaton(shard.value, window) if shard else None
    for rows, texts in sliced(batches):
        if automaton:
            scans = [automaton.scan(text.translate(LOWER_WORDS).split()) for text in texts]
            hits, items = [np.array(spans, dtype=np.int32).tobytes() for spans, _ in scans], [sorted(found) for _, found in scans]
        elif "hits" in rows.schema.names:
            hits, items = [b"".join(h or ()) for h in rows.column("hits").to_pylist()], [sorted(i or ()) for i in rows.column("items").to_pylist()]
        else:
            hits, items = [b""] * len(texts), [[]] * len(texts)
        yield rows, texts, hits, items


def _result(text: bytes, hits: bytes) -> tuple[int, int, list[dict]]:
    """(n_words, n_hit, spans in characters)"""
    if not hits:
        return len(text.translate(LOWER_WORDS).split()), 0, []
    starts, ends = find_words(text.translate(LOWER_WORDS))
    gone = _covered(hits, len(starts))
    step = np.diff(gone.astype(np.int8), prepend=0, append=0)
    characters = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    bounds = zip(characters[starts[np.flatnonzero(step == 1)]].tolist(), characters[ends[np.flatnonzero(step == -1) - 1]].tolist())
    return len(starts), int(gone.sum()), [{"start": a, "end": b} for a, b in bounds]


def _scanned(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, max_bytes: int) -> tuple:
    """(docs, the shard to scan them with): with several shards none, and docs has what their scans found."""
    shards = _shards(benchmark, item_col, item_text_col, window, max_bytes)
    if len(shards) < 2:
        return docs, shards[0]() if shards else None
    docs = stored(docs.withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    found = []
    for load in shards:
        shard = load()
        found.append(cut(docs.select("row_id", "text").mapInArrow(_hits(shard, window), "row_id long, hits binary, items array<string>")))
        shard.destroy()
    together = reduce(DataFrame.union, found).groupBy("row_id").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # a row a shard at most
    return docs.join(together, "row_id", "left").drop("row_id"), None


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, min_hit_percent: int = 5, max_bytes: int = 4 << 20) -> DataFrame:
    """The id column, n_words, n_hit, item_ids (sorted strings), spans (character offsets into the text) and contaminated of each row.

    Contaminated: some word is hit, and at least ``min_hit_percent`` of all words.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    scanned, shard = _scanned(docs, benchmark, item_col, item_text_col, window, max_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, hits, items in _found(shard, window, batches):
            n_words, n_hit, spans = zip(*map(_result, texts, hits))
            words, hit = np.array(n_words, dtype=np.int64), np.array(n_hit, dtype=np.int64)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [rows.column("id"), pa.array(words), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, kinds), pa.array((hit > 0) & (100 * hit >= min_hit_percent * words))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "item_ids", "spans", "contaminated"])

    return scanned.mapInArrow(run, RESULT.format(kind)).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, min_hit_percent: int = 5, max_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns as they are."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    scanned, shard = _scanned(packed, benchmark, item_col, item_text_col, window, max_bytes)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, hits, _ in _found(shard, window, batches):
            stay = []
            for text, own in zip(texts, hits):
                n = len(text.translate(LOWER_WORDS).split()) if own else 0
                hit = int(_covered(own, n).sum()) if own else 0
                stay.append(not (hit and 100 * hit >= min_hit_percent * n))
            yield pa.RecordBatch.from_arrays([rows.column("row")], ["row"]).filter(pa.array(stay))

    kept = scanned.mapInArrow(keep, packed.select("row").schema)
    return kept.select(*[F.col("row").getField(n).alias(n) for n in names])
