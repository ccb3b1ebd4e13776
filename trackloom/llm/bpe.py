"""Byte-level BPE encoding and decoding with a given rank file.

Method: every distinct piece of text (a match of the split pattern) is a row of
a padded matrix of token ids, in buckets of similar length. Each round merges
the leftmost pair of least rank of every row at once; pair ranks come from an
open-addressing hash table probed for whole arrays; rows without a mergeable
pair leave the matrix, which also loses a column a round. Pieces longer than
``LONG`` bytes would need as many rounds as they have bytes, so they go through
the same merges with a heap. Encoded pieces are remembered within a task, up to
``REMEMBER`` of them or ``REMEMBER_BYTES``.

Nulls and edge cases: a null or empty text has no tokens; there are no special
tokens, so their strings in a text are ordinary text; repeated rows get equal
results; ids that are null or empty decode to nothing, ids outside the vocabulary raise an
error; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.textbytes import ranges, sliced, worker_model

NONE = np.int32(2**31 - 1)
LONG = 256
REMEMBER, REMEMBER_BYTES = 150_000, 16 << 20
SLICE_IDS = 1 << 18
MAX_VOCABULARY_BYTES = 64 << 20
CELLS = 1 << 19
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG)


class PairTable:
    """(left id, right id) -> rank of the merged token, for arrays of pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            free = self.keys[slot[rest]] < 0
            _, first = np.unique(slot[rest[free]], return_index=True)
            put = rest[free][first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            rest = rest[self.keys[slot[rest]] != key[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where a pair doesn't merge or an id is negative (padding)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class BytePairCodec:
    """Encodes and decodes by a rank file's content."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int32).T)
        tokens = {r: t for t, r in ranks.items()}
        texts = [tokens.get(r, b"") for r in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.token_lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.forget()

    def forget(self) -> None:
        self.known, self.pending = _Codes(), []
        self.known.new = self.pending
        self.ids, self.used, self.size = np.zeros(1 << 16, dtype=np.int32), 0, 0
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text the number of ids before it (n + 1 values)."""
        if len(self.known) > REMEMBER or self.size > REMEMBER_BYTES:
            self.forget()
        codes, counts = [], []
        for text in texts:
            pieces = self.pattern.findall(text)
            codes += map(self.known.__getitem__, pieces)
            counts.append(len(pieces))
        if self.pending:
            self._learn([p.encode() for p in self.pending])
            self.pending.clear()
        codes = np.array(codes, dtype=np.int64)
        lengths = self.lengths[codes]
        ids = self.ids[ranges(self.starts[codes], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ranges(self.token_starts[ids], self.token_lengths[ids])].tobytes()

    def byte_counts(self, ids: np.ndarray) -> np.ndarray:
        return self.token_lengths[ids]

    def _learn(self, pieces: list[bytes]) -> None:
        sizes = np.array([len(p) for p in pieces])
        self.size += int(sizes.sum())
        whole = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int32)
        direct = np.flatnonzero(whole >= 0)
        found = [(direct, np.ones(len(direct), dtype=np.int64), whole[direct])]
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= width))
            step = max(1, CELLS // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                found += [(part[i], n, ids) for i, n, ids in self._merge([pieces[k] for k in part.tolist()], width)]
            low = width
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            ids = self._merge_long(pieces[i])
            found.append((np.array([i]), np.array([len(ids)]), ids))
        row, lengths, flat = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        total = len(flat)
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = flat[ranges(starts, lengths)]
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += total

    def _merge(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of pieces, how many ids each has, the ids) as rows of the matrix get done."""
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            open_ = least != NONE
            if not open_.all():
                done = ids[~open_]
                yield rows[~open_], (done >= 0).sum(axis=1), done[done >= 0]
            rows, ids, ranks, at, least = rows[open_], ids[open_], ranks[open_], at[open_], least[open_]
            if not len(rows):
                return
            every = np.arange(len(rows))
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ids[every, at] = least
            columns = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.pairs.get(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < ranks.shape[1])
            ranks[has, at[has]] = self.pairs.get(ids[has, at[has]], ids[has, at[has] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: least rank first, leftmost among equals."""
        n = len(piece)
        start_of_next = list(range(1, n + 1))
        start_of_previous = list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged since
            end[middle], end[i] = -1, stop
            start_of_next[i] = stop
            if stop < n:
                start_of_previous[stop] = i
                if (r := self.ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (j := start_of_previous[i]) >= 0 and (r := self.ranks.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return np.array(out, dtype=np.int32)


class _Codes(dict):
    """piece -> number, in order of appearance; new pieces are noted."""

    new: list[str]

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def _codec(rank_file: bytes, pattern: str) -> BytePairCodec:
    return worker_model(rank_file + pattern.encode(), lambda: BytePairCodec(rank_file, pattern))


def _vocabulary(docs: DataFrame, path: str):
    """The rank file as a broadcast variable; only the driver needs the path."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(content)


def _texts(rows: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in rows.column("text").to_pylist()]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ids array<int> of each row."""
    vocabulary = _vocabulary(docs, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for rows, _ in sliced(batches):
            ids, bounds = codec.encode(_texts(rows))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("id"), lists], [id_col, "ids"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and the decoded bytes of each row; null ids decode to nothing. Lists are taken ``SLICE_IDS`` ids at a time, a longer one alone."""
    vocabulary = _vocabulary(encoded, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ids, bounds, low = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]), 0
            while low < len(sizes):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE_IDS, side="right")) - 1)
                own = bounds[low : high + 1]
                text, cuts = codec.decode(ids[own[0] : own[-1]]), np.concatenate([[0], np.cumsum(codec.byte_counts(ids[own[0] : own[-1]]))])[own - own[0]].tolist()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], [id_col, "decoded"])
                low = high

    encoded = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return encoded.mapInArrow(run, f"`{id_col}` {encoded.schema['id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the digests of a text's ids and of the bytes they decode to, in one pass."""
    vocabulary = _vocabulary(docs, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for rows, _ in sliced(batches):
            ids, bounds = codec.encode(_texts(rows))
            raw, decoded = memoryview(ids.astype("<u4").tobytes()), memoryview(codec.decode(ids))
            cuts = np.concatenate([[0], np.cumsum(codec.byte_counts(ids))])[bounds].tolist()
            at = bounds.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
