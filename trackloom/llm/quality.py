"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Features of a text (split on white space): each word, each pair of neighbours,
and one to three neighbouring word shapes (case, punctuation, digits, length,
equal to the word before), hashed to ``SIZE`` buckets. A feature's value is its
count divided by the number of features of its kind, so long and short texts
compare; a score is a sparse dot product, taken as a mean of weights over the
whole text.

Training takes at most ``max_train`` labelled texts, those with the smallest
hash of their id: a bounded sample. Their features are computed where the texts
are; only examples of at most ``SIZE`` numbers each meet in one task, and no more
than ``max_train``, however many documents have one id. Everything else covers
all rows.

Nulls and edge cases: a null or empty text has only the intercept; a null label
or a label without document is left out; several labels of one document, or
texts of one id, all count, but equal ones once; without labels every score is
0.5; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.ftrl import Ftrl, sigmoid
from trackloom.llm.textbytes import encode, hash_spans, join_words, mix, ngram_hashes, sliced, SPACE_WORDS

BITS = 18
SIZE = 1 << BITS
SCALE = 12.0
BIAS = 0


def _shape(buf: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(buf, dtype=np.uint8)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128))])
    digit = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    size = ends - starts
    n_upper, n_letter, n_digit = upper[ends] - upper[starts], letter[ends] - letter[starts], digit[ends] - digit[starts]
    n_other = np.minimum(size - n_letter - n_digit, 3)
    case = np.where(n_upper == 0, 0, np.where(n_upper == 1, 1, np.where(2 * n_upper >= n_letter, 3, 2)))
    last = np.where((raw[ends - 1] | 32 >= 97) & (raw[ends - 1] | 32 <= 122) | (raw[ends - 1] >= 128), 0, raw[ends - 1].astype(np.int64))
    again = np.zeros(len(words), dtype=np.int64)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = 0  # a text's first word repeats none
    length = np.minimum(np.log2(size).astype(np.int64), 7)
    code = ((((again * 8 + length) * 4 + case) * 4 + n_other) * 2 + (n_digit > 0)) * 256 + last
    return mix(code.astype(np.uint64) + np.uint64(1))


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets of all texts, and the number before each text's own (with the total)."""
    buf, starts, ends, bounds = join_words(texts, SPACE_WORDS)
    if not len(starts):
        return [(np.zeros(0, dtype=np.int64), bounds)] * 5
    words = hash_spans(buf.lower(), starts, ends)
    shapes = _shape(buf, starts, ends, words, bounds)
    out = []
    for kind, (hashes, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        grams = ngram_hashes(hashes, n)
        inside = np.ones(len(grams), dtype=bool)
        for j in range(1, n):  # n-grams that reach into the next text
            at = bounds[1:-1] - j
            inside[at[(at >= 0) & (at < len(grams))]] = False
        keep = np.concatenate([[0], np.cumsum(inside)])
        bucket = (mix(grams[inside] + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append((np.where(bucket == BIAS, 1, bucket), keep[np.minimum(bounds, len(grams))]))
    return out


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), weights[BIAS])
    for bucket, bounds in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(weights[bucket])])
        counts = np.diff(bounds)
        out += SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(counts, 1)
    return out


def example(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, values) of one text."""
    index, value = [np.array([BIAS])], [np.ones(1)]
    for bucket, _ in features([text]):
        if len(bucket):
            index.append(bucket)
            value.append(np.full(len(bucket), SCALE / len(bucket)))
    i, place = np.unique(np.concatenate(index), return_inverse=True)
    return i.astype(np.int32), np.bincount(place, np.concatenate(value)).astype(np.float32)


EXAMPLE = "rank long, label double, buckets binary, numbers binary"


def example_batch(rows: pa.RecordBatch, examples: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Examples (int32 buckets, float32 numbers) as rows of ``EXAMPLE``; ``rows`` has rank and label."""
    packed = [(i.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()) for i, x in examples]
    buckets, numbers = zip(*packed) if packed else ((), ())
    return pa.RecordBatch.from_arrays([rows.column("rank"), rows.column("label"), pa.array(buckets, pa.binary()), pa.array(numbers, pa.binary())], ["rank", "label", "buckets", "numbers"])


def read_examples(batches: Iterable[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    return [
        (np.frombuffer(i, dtype=np.int32), np.frombuffer(x, dtype=np.float32), y)
        for batch in batches
        for i, x, y in zip(batch.column("buckets").to_pylist(), batch.column("numbers").to_pylist(), batch.column("label").to_pylist())
    ]


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in sliced(batches):
        yield example_batch(rows, map(example, texts))


def _fit(epochs: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, examples = Ftrl(SIZE), read_examples(batches)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                i, x, y = examples[k]
                model.update(i, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return run


def training_examples(docs: DataFrame, labels: DataFrame, label_col: str, held_out, max_train: int, examples: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``max_train`` rows of ``EXAMPLE`` in one partition; ``examples``: batches of rank, label, text -> their examples."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # at most max_train small rows
    found = joined.distinct().select(F.xxhash64("id", "text").alias("rank"), "label", "text").mapInArrow(examples, EXAMPLE)
    return found.orderBy("rank", "label").limit(max_train).coalesce(1)


def train(docs: DataFrame, labels: DataFrame, label_col: str, held_out, max_train: int = 6000, epochs: int = 4) -> np.ndarray:
    """Weights; ``held_out``: id column -> condition of ids that training leaves out."""
    rows = training_examples(docs, labels, label_col, held_out, max_train, _examples).mapInArrow(_fit(epochs), "weights binary").collect()
    return np.frombuffer(rows[0].weights, dtype=np.float32).astype(np.float64) if rows else np.zeros(SIZE)


def fold(id_column, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(id_column.cast("string").cast("binary")) % n


def _scored(docs: DataFrame, weights: np.ndarray, text_col: str) -> DataFrame:
    """row (a struct of all columns of ``docs``), score."""
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value.astype(np.float64)
        for rows, texts in sliced(batches):
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(sigmoid(margins(texts, weights)))], ["row", "score"])

    return packed.mapInArrow(run, packed.select("row").schema.add("score", "double"))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1, in place of a column of that name; rows don't move."""
    columns = [F.col("row").getField(n).alias(n) for n in docs.columns if n != score_col]
    return _scored(docs, weights, text_col).select(*columns, F.col("score").alias(score_col))


def keep_good(docs: DataFrame, weights: np.ndarray, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns as they are."""
    return _scored(docs, weights, text_col).where(F.col("score") >= least).select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
