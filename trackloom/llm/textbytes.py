"""Vectorised word handling on UTF-8 bytes, shared by the Arrow-based operators.

Texts of an Arrow batch are taken in slices of a few MB (a longer text is a
slice of its own), so a task's memory depends on neither batch nor table size.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
MULT = 0x9E3779B97F4A7C15
INV = pow(MULT, -1, 1 << 64)

#: A-Z lower-cased; everything but digits, letters and non-ASCII bytes a space.
LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
#: Space and \t..\r become one kind of space; all else stays.
SPACE_WORDS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_powers: list[np.ndarray] = []


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: a worker waits for its next one without it."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do this by themselves
        ctypes.CDLL(None).malloc_trim(0)


_model: list = [b"", None]


def worker_model(source: bytes, build: Callable):
    """What ``build`` makes of ``source``; a Python worker keeps the last one only."""
    key = hashlib.sha256(source).digest()
    if _model[0] != key:
        _model[:] = [b"", None]
        _model[:] = [key, build()]
    return _model[1]


def encode(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def sliced(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as bytes) with about ``limit`` bytes of text at a time."""
    for batch in batches:
        rows, texts, at, size = 0, [], 0, 0
        for low in range(0, batch.num_rows, 64):
            for t in encode(batch.column(text).slice(low, 64).to_pylist()):
                if size and size + len(t) > limit:
                    yield batch.slice(at, rows - at), texts
                    texts, at, size = [], rows, 0
                texts.append(t)
                size += len(t)
                rows += 1
        if texts:
            yield batch.slice(at), texts
    give_back()


def find_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs that aren't spaces."""
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = np.frombuffer(buf, dtype=np.uint8) != 32
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def join_words(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one buffer; word starts, ends, and for each text the number of words before it (n + 1 values)."""
    buf = b" ".join(texts).translate(table)
    starts, ends = find_words(buf)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(29))


def hash_spans(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], from prefix sums of byte * MULT**i (mod 2**64).

    The spans are in order and don't overlap; they are taken SLICE_BYTES at a time.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    raw, at = np.frombuffer(buf, dtype=np.uint8), 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
        part = raw[low : int(ends[stop - 1])]
        pw, inverse = _power(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part + np.uint64(1)) * pw[: len(part)], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * inverse[s])
        at = stop
    return out


def _power(n: int) -> list[np.ndarray]:
    """MULT**i and INV**i for i up to n at least; only those of SLICE_BYTES are kept."""
    if n > SLICE_BYTES or not _powers:
        found = [np.cumprod(np.array([1] + [f] * max(n, SLICE_BYTES), dtype=np.uint64), dtype=np.uint64) for f in (MULT, INV)]
        if n > SLICE_BYTES:
            return found
        _powers[:] = found
    return _powers


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes (their order counts)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(MULT) + words[j : len(words) - n + 1 + j]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (length values) for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths) + np.arange(total)
