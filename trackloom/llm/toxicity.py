"""Toxicity of texts whose words may be disguised.

Method: a noisy channel. Words that look disguised (leetspeak signs among
letters, letters set apart by single spaces or signs, repeated letters) become
character lattices; Viterbi decoding takes the most likely letters under a
character 4-gram model, counted over all documents, and the channel's costs.
The restored text is then scored by a logistic regression on its distinct words
and word beginnings, trained by FTRL.

Counts of the character model are summed in each task and then by Spark; the
alphabet bounds the table (``LETTERS`` ** 4 numbers). Training takes at most
``max_train`` labelled texts, those with the smallest hash of their id; of long
ones with one label that share four fifths of their features, one counts, so
copies don't pass for evidence. Texts are restored where they are; only examples
of distinct feature numbers meet in one task.

Nulls and edge cases: a null or empty text has only the intercept; null labels
and labels without document are left out; without labels every score is 0.5;
disguised words and spaced passages are decoded whatever their length, codes and
hashes too (their letters just make no word that was learnt); repeated rows get
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.ftrl import Ftrl, sigmoid
from trackloom.llm.quality import example_batch, read_examples, training_examples
from trackloom.llm.textbytes import find_words, hash_spans, mix, sliced, worker_model

BITS = 20
SIZE = 1 << BITS
BIAS = 0
NOISE, LEAST_ROWS, LEAST_SHARE, KEEP = 2.5, 3, 0.5, 0.75
REMEMBER, REMEMBER_BYTES = 200_000, 64  # decoded words, and the longest of them

# Which letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}

LETTERS = 28  # a space, a-z, any other letter
SPACE, OTHER = 0, 27
SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else OTHER if b >= 128 else SPACE for b in range(256)], dtype=np.uint8)
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
IS_LEET = np.array([chr(b) in LEET for b in range(256)])
IS_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
IS_GAP = np.array([chr(b) in " \t\n\r.,-_*~/'" for b in range(256)])
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

LEET_COST, KEEP_COST, DOUBLE_COST, SINGLE_COST, GAP_COST = 0.7, 6.0, 0.5, 1.0, 3.0


def _count_symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LETTERS**4, dtype=np.int64)
    for _, texts in sliced(batches):
        raw = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
        s = SYMBOL[raw[(raw & 0xC0) != 0x80]]  # one symbol a character, as lattices have
        s = s[np.concatenate([[True], (s[1:] != SPACE) | (s[:-1] != SPACE)])].astype(np.int32)
        if len(s) > 3:
            counts += np.bincount(((s[:-3] * LETTERS + s[1:-2]) * LETTERS + s[2:-1]) * LETTERS + s[3:], minlength=LETTERS**4)
    seen = np.flatnonzero(counts)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["gram", "n"])


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram (four symbols as a number), n over all rows."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_symbols, "gram int, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """-log p(symbol | the three before it), smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray, weight: float = 4.0):
        c = counts.reshape((LETTERS,) * 4).astype(np.float64)
        p = np.full(LETTERS, 1 / LETTERS)
        for order in range(4):
            n = c.sum(axis=tuple(range(3 - order)))
            p = (n + weight * p) / (n.sum(axis=-1, keepdims=True) + weight)
        self.cost = -np.log(p).astype(np.float32).reshape(-1)

    def decode(self, lattice: list[list[tuple[tuple[int, ...], float]]]) -> list[int]:
        """The cheapest symbols between two spaces; lattice: for each place (symbols, cost) choices."""
        cost = self.cost
        states: dict[int, tuple[float, tuple]] = {SPACE: (0.0, ())}
        for choices in [*lattice, [((SPACE,), 0.0)]]:
            following: dict[int, tuple[float, tuple]] = {}
            for state, (so_far, trail) in states.items():
                for symbols, extra in choices:
                    total, at = so_far + extra, state
                    for s in symbols:
                        total += float(cost[at * LETTERS + s])
                        at = (at * LETTERS + s) % LETTERS**3
                    if at not in following or total < following[at][0]:
                        following[at] = (total, (trail, symbols) if symbols else trail)
            states = following
        _, trail = min(states.values(), key=lambda x: x[0])
        out: list[int] = []
        while trail:
            trail, symbols = trail
            out += symbols[::-1]
        return out[:0:-1]


def lattice(word: str) -> tuple[list[list[tuple[tuple[int, ...], float]]], list[str]]:
    """Choices for each place of a disguised word, and the characters that OTHER symbols stand for."""
    out, others, i = [], [], 0
    runs = sum(a == b != c for a, b, c in zip(word, word[1:], word[2:] + " "))
    single = SINGLE_COST if runs < 3 else 0.0  # every letter doubled
    while i < len(word):
        c, run = word[i], 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        if "a" <= c <= "z":
            s = ord(c) - 96
            if run == 1:
                out.append([((s,), 0.0)])
            else:
                out.append([((s,), 0.0 if run > 2 else single), ((s, s), DOUBLE_COST if run > 2 else 0.0)])
        elif c in LEET:
            choices = [((ord(x) - 96,), LEET_COST) for x in LEET[c]]
            if run > 1:
                choices += [((ord(x) - 96,) * 2, LEET_COST + DOUBLE_COST) for x in LEET[c]]
            choices += [((SPACE,), KEEP_COST), ((), KEEP_COST)]
            out.append(choices)
        elif ord(c) >= 128:
            out += [[((OTHER,), 0.0)]] * run
            others += [c] * run
        else:
            out.append([((), 0.0), ((SPACE,), GAP_COST)])
        i += run
    return out, others


class Restorer:
    def __init__(self, counts: np.ndarray):
        self.model, self.known = CharacterModel(counts), {}

    def word(self, raw: bytes) -> bytes:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            text = raw.decode("utf-8", "replace").lower()
            body = text.rstrip(" .,;:!?|\"')")
            if len(body) < 2:
                found = raw
            else:
                choices, others = lattice(body.lstrip(" \"'("))
                others = iter(others)
                symbols = self.model.decode(choices)
                found = "".join(" " if s == SPACE else next(others, "") if s == OTHER else chr(96 + s) for s in symbols).encode()
            if len(raw) <= REMEMBER_BYTES:
                self.known[raw] = found
        return found

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The texts with their disguised words decoded."""
        buf = b" \n ".join([b"", *texts, b""])
        raw = np.frombuffer(buf, dtype=np.uint8)
        spans = self._disguised(raw)
        if not spans:
            return texts
        cuts = np.cumsum([len(t) + 3 for t in texts]) - [len(t) for t in texts]  # where each text starts
        own = np.searchsorted(cuts, [a for a, _ in spans], side="right") - 1
        out, by_text = list(texts), {}
        for k, span in zip(own.tolist(), spans):
            by_text.setdefault(k, []).append(span)
        for k, found in by_text.items():
            parts, at = [], int(cuts[k])
            end = at + len(texts[k])
            for a, b in found:
                b = min(b, end)
                if a >= at and b > a:
                    parts += [buf[at:a], self.word(buf[a:b])]
                    at = b
            out[k] = b"".join([*parts, buf[at:end]])
        return out

    @staticmethod
    def _disguised(raw: np.ndarray) -> list[tuple[int, int]]:
        letter, leet = IS_LETTER[raw], IS_LEET[raw]
        low = raw | np.uint8(32)
        event = np.zeros(len(raw), dtype=bool)
        event[:-1] |= leet[:-1] & letter[1:]
        event[:-2] |= leet[:-2] & leet[1:-1] & letter[2:]
        event[1:] |= IS_DIGIT[raw[1:]] & letter[:-1]
        twice = letter[1:] & letter[:-1] & (low[1:] == low[:-1])
        event[2:] |= twice[1:] & twice[:-1]
        starts, ends = find_words(np.where(IS_SPACE[raw], np.uint8(32), raw).tobytes())
        sums = np.concatenate([[0], np.cumsum(event)])
        doubles = np.concatenate([[0], np.cumsum(np.concatenate([[False], twice]))])
        letters = np.concatenate([[0], np.cumsum(letter)])
        flagged = ((sums[ends] > sums[starts]) | (doubles[ends] - doubles[starts] > 1)) & (letters[ends] > letters[starts])
        spans = list(zip(starts[flagged].tolist(), ends[flagged].tolist()))
        # Single characters with single gaps between them, three at least.
        sign, gap = letter | leet, IS_GAP[raw]
        alone = np.zeros(len(raw), dtype=bool)
        alone[1:-1] = sign[1:-1] & gap[:-2] & gap[2:]
        spaced: list[tuple[int, int]] = []
        for odd in (0, 1):
            a = alone[odd::2].astype(np.int8)
            step = np.diff(a, prepend=0, append=0)
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            long = e - s >= 3
            spaced += [(odd + 2 * x, odd + 2 * y - 1) for x, y in zip(s[long].tolist(), e[long].tolist()) if letter[odd + 2 * x : odd + 2 * y].any()]
        if not spaced:
            return spans
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans + spaced):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word beginnings (4 to 6 bytes) of all texts, and the number of each one's text."""
    buf = b" ".join(texts).translate(WORD_TABLE)
    starts, ends = find_words(buf)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    text = np.searchsorted(offsets, starts, side="right") - 1
    found, own = [mix(hash_spans(buf, starts, ends) + np.uint64(1))], [text]
    for n in (4, 5, 6):
        some = ends - starts > n
        found.append(mix(hash_spans(buf, starts[some], starts[some] + n) + np.uint64(n)))
        own.append(text[some])
    bucket = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.where(bucket == BIAS, 1, bucket), np.concatenate(own)


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), weights[BIAS])
    bucket, own = features(texts)
    some = weights[bucket] != 0
    pairs = np.unique(own[some] * SIZE + bucket[some])
    return out + np.bincount(pairs >> BITS, weights[pairs & (SIZE - 1)], minlength=len(texts)) if len(pairs) else out


def _restorer(counts: bytes) -> Restorer:
    return worker_model(counts, lambda: Restorer(np.frombuffer(counts, dtype=np.int64)))


def _without_copies(examples: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, float]]:
    """Of long texts that share four fifths of their features, one."""
    kept: list[tuple[np.ndarray, float]] = []
    like: dict[tuple, list[np.ndarray]] = {}
    for i, y in examples:
        if len(i) > 40:
            # Buckets are hashes in order, so near copies nearly always have the same first ones; so may other texts.
            others = like.setdefault((tuple(i[1:9].tolist()), y), [])
            if any(9 * len(np.intersect1d(i, o, assume_unique=True)) >= 4 * (len(i) + len(o)) for o in others):
                continue
            others.append(i)
        kept.append((i, y))
    return kept


def feature_values(examples: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """How far a feature's share of toxic examples is above the share of all, in standard errors past ``NOISE``; 0 for rare features and for those that most examples with them aren't toxic for."""
    examples = _without_copies(examples)
    n = np.bincount(np.concatenate([i for i, _ in examples]), minlength=SIZE) if examples else np.zeros(SIZE)
    toxic = np.bincount(np.concatenate([i if y > 0.5 else i[:0] for i, y in examples]), minlength=SIZE) if examples else np.zeros(SIZE)
    share = sum(y > 0.5 for _, y in examples) / max(1, len(examples))
    z = (toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    out = np.where((n >= LEAST_ROWS) & (toxic >= LEAST_SHARE * n), np.clip((z - NOISE) / 3, 0, 3), 0.0)
    out[BIAS] = 1.0
    return out


def _examples(counts) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(counts.value)
        for rows, texts in sliced(batches):
            bucket, own = features(restorer.texts(texts))
            pairs = np.unique(own * SIZE + bucket)
            cuts = np.searchsorted(pairs, np.arange(len(texts) + 1) * SIZE)
            yield example_batch(rows, ((np.concatenate([[BIAS], pairs[a:b] & (SIZE - 1)]), np.zeros(0)) for a, b in zip(cuts, cuts[1:])))

    return run


def _fit(epochs: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, examples = Ftrl(SIZE, alpha=0.5, l1=0.1), [(i, y) for i, _, y in read_examples(batches)]
        value = feature_values(examples)
        examples = [(i[value[i] > 0], y) for i, y in examples]
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                i, y = examples[k]
                some = i[(i == BIAS) | (order.random(len(i)) < KEEP)]  # so that each word learns to tell by itself
                model.update(some, value[some], y)
        weights = (model.weights() * value).astype(np.float32)
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([weights[some].tobytes()], pa.binary())], ["buckets", "weights"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 6000, epochs: int = 12) -> DataFrame:
    """The id column and score (0 to 1, higher: more likely toxic) of each row of ``docs``.

    ``held_out``: id column -> condition of ids that training leaves out.
    """
    sc = docs.sparkSession.sparkContext
    table = np.zeros(LETTERS**4, dtype=np.int64)
    for r in character_counts(docs, text_col).toArrow().to_batches():  # at most LETTERS ** 4 rows
        table[r.column("gram").to_numpy()] = r.column("n").to_numpy()
    counts = sc.broadcast(table.tobytes())
    rows = training_examples(docs, labels, label_col, held_out, max_train, _examples(counts), id_col, text_col).mapInArrow(_fit(epochs), "buckets binary, weights binary").collect()
    dense = np.zeros(SIZE)
    if rows:
        dense[np.frombuffer(rows[0].buckets, dtype=np.int32)] = np.frombuffer(rows[0].weights, dtype=np.float32)
    some = np.flatnonzero(dense)
    model = sc.broadcast((some, dense[some]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, weights = _restorer(counts.value), np.zeros(SIZE)
        weights[model.value[0]] = model.value[1]
        for rows, texts in sliced(batches):
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sigmoid(margins(restorer.texts(texts), weights)))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
