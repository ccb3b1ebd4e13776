"""Hidden states of motion fitted to each object: one, two and three states with heavy-tailed likelihoods.

A series is stored in chunks of rows. A task turns a chunk into two small
matrices, which take any vector of state chances across it, forwards and
backwards; folding these along a series gives each chunk the chances at both its
ends, and every chunk then adds its share of the sums that the parameters are
estimated from. So a round over a series of any length is two scans of its chunks
and a fold over matrices. A series of one chunk is fitted whole, with the same
steps, inside one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.batches import arrow_schema, batch_of, by_group, in_tasks
from trackloom.operators.states import NAMES, transition_matrix
from trackloom.plans.lineage import cut, stored

CHUNK, MOST_STATES, MOST_ROUNDS = 50_000, 3, 30
#: Short series that a task fits, some tens of milliseconds each.
SERIES = 64
MODEL = "states long, params array<double>, moves array<double>, entropy double, weights array<double>, rounds long"


def likelihoods(params: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows x states: chance of a reversal (or none) times a density that falls with the sixth power of the Mahalanobis distance.

    params: states x ``NAMES``; seen: rows x (reversal, speed, along, radial).
    """
    pr, ms, ma, vs, va, vr, cov = params.T
    r, s, a, ar = (seen[:, [k]] for k in range(4))
    plane = vs * va - cov * cov
    square = (va * (s - ms) ** 2 - 2 * cov * (s - ms) * (a - ma) + vs * (a - ma) ** 2) / plane + ar * ar / vr
    return np.where(r > 0.5, pr, 1 - pr) * 4 / (np.pi**2 * np.sqrt(plane * vr)) / (1 + square) ** 3


def usable(params: np.ndarray) -> bool:
    """Do all states have a covariance matrix with a positive determinant?"""
    _, _, _, vs, va, vr, cov = params.T
    return bool(np.isfinite(params).all() and ((vs * va - cov * cov) * vr > 0).all() and (vs > 0).all())


def crossing_matrices(p: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What takes chances across rows with likelihoods p, up to a factor: (from the row before the first to the last, from the row after the last to the first)."""
    ahead, back = np.eye(len(moves)), np.eye(len(moves))
    for row in p:
        ahead = row[:, None] * (moves @ ahead)
        ahead /= ahead.max() or 1.0
        back = back @ (moves * row)
        back /= back.max() or 1.0
    return ahead, back


def normal(v: np.ndarray) -> np.ndarray:
    total = v.sum(axis=-1, keepdims=True)
    return np.where(total > 0, v / np.where(total > 0, total, 1), 1 / v.shape[-1])


def posteriors(p: np.ndarray, moves: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rows x states: chances given the whole series; before and after: the chances at both ends. A row's likelihood counts on the way ahead and on the way back."""
    ahead, back = np.empty_like(p), np.empty_like(p)
    v = before
    for i, row in enumerate(p):
        ahead[i] = v = normal(row * (moves @ v))
    v = after
    for i in range(len(p) - 1, -1, -1):
        back[i] = v = normal(moves @ (p[i] * v))
    return normal(ahead * back)


def moments(rel: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """10 x states: sums that parameters, weights and entropy are made of, and that add up over chunks."""
    r, s, a, ar = (seen[:, [k]] for k in range(4))
    logs = np.where(rel > 0, rel * np.log2(np.where(rel > 0, rel, 1)), 0)
    return np.stack([t.sum(axis=0) for t in (rel, rel * rel, rel * r, rel * s, rel * a, rel * s * s, rel * a * a, rel * ar * ar, rel * a * s, logs)])


def estimates(m: np.ndarray) -> np.ndarray:
    """states x ``NAMES`` from moments: weighted means, and variances with the weights' correction."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = m[2:9] / m[0]
        more = 1 / (1 - m[1] / (m[0] * m[0]))
    pr, s, a, ss, aa, rr, sa = mean
    return np.stack([pr, s, a, more * (ss - s * s), more * (aa - a * a), rr, more * (sa - a * s)], axis=1)


def pooled(params: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Parameters with all variances and the covariance replaced by their means over the states, by weight."""
    out = params.copy()
    out[:, 3:] = (m[0] / m[0].sum()) @ params[:, 3:]
    return out


def entropy(m: np.ndarray) -> float:
    """How much the rows' chances tell more than the states' shares, in bits."""
    share = m[0] / m[0].sum()
    return float(m[9].sum() / m[0].sum() - (share[share > 0] * np.log2(share[share > 0])).sum())


def pair_sums(p: np.ndarray) -> np.ndarray:
    """states x states: sums of the products of the likelihoods of rows and the rows after them."""
    return p[:-1].T @ p[1:]


def new_moves(moves: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return normal(moves * pairs)


def begun(params: np.ndarray) -> np.ndarray:
    """Parameters to begin with for one state more: the last one again, with a speed that is higher by one."""
    out = np.vstack([params, params[-1:]])
    out[-1, 1] += 1
    return out


class Fit:
    """The closed loop of one series for one number of states; ``add`` takes the moments of a round."""

    def __init__(self, params: np.ndarray, moves: np.ndarray, rounds: int = 0, settled: bool = False):
        self.params, self.moves, self.rounds, self.settled = params, moves, rounds, settled

    def add(self, m: np.ndarray) -> None:
        """New parameters; it is settled when they change by 0.1 in all at most, after ``MOST_ROUNDS``, or where a state has no spread."""
        fresh = estimates(m)
        self.rounds += 1
        if not usable(fresh):
            self.settled = True
            return
        even = pooled(fresh, m)
        still = self.rounds > 1 and np.abs(even - self.params).sum() <= 0.1
        self.settled = bool(still or self.rounds >= MOST_ROUNDS)
        self.params = fresh if self.settled else even


def whole_fits(seen: np.ndarray, tau: float, step: float) -> Iterator[tuple]:
    """(states, params, moves, entropy, weights, rounds) of a series for one, two and three states, as long as they can be told apart."""
    m = moments(np.ones((len(seen), 1)), seen)
    params = estimates(m)
    for states in range(1, MOST_STATES + 1):
        if not usable(params):
            return
        if states > 1:
            fit = Fit(params, np.array(transition_matrix(tau, step, states)))
            while not fit.settled:
                rel = posteriors(likelihoods(fit.params, seen), fit.moves, np.full(states, 1 / states), np.ones(states))
                m = moments(rel, seen)
                fit.add(m)
            params = fit.params
            moves, rounds = new_moves(fit.moves, pair_sums(likelihoods(params, seen))), fit.rounds
        else:
            moves, rounds = np.ones((1, 1)), 0
        yield states, params.ravel().tolist(), moves.ravel().tolist(), entropy(m), (m[0] / m[0].sum()).tolist(), rounds
        params = begun(params)


def packed(df: DataFrame, columns: tuple[str, str, str, str], key: str, order: str, chunk: int) -> DataFrame:
    """key, chunk, seen: the observations of each chunk of ``chunk`` orders, row after row; rows with a null are left out."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.floor(F.col(order) / chunk).cast("long").alias("chunk"), F.col(order).alias("order"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    each = lambda k, group: [(*k, [v for g in group for v in g[1:]])]
    return by_group(rows, ["key", "chunk"], ["order"], each, f"key {kind}, chunk long, seen array<double>")


def _per_row(df: DataFrame, each, ddl: str) -> DataFrame:
    """``each(row as a dict)`` yields result rows."""
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = list(each({c: batch.column(c)[k].as_py() for c in batch.schema.names}))
                if out:
                    yield batch_of(out, schema)

    return df.mapInArrow(run, ddl)


def _square(values: list[float]) -> np.ndarray:
    n = int(round(len(values) ** 0.5))
    return np.array(values).reshape(n, n)


def _long_fits(chunks: DataFrame, kind: str, tau: float, step: float) -> DataFrame:
    """The fits of series of several chunks: rounds of scans and folds, until every series is settled."""
    seen_of = lambda r: np.array(r["seen"]).reshape(-1, 4)
    shape = f"key {kind}, chunk long"
    model_ddl = f"key {kind}, {MODEL}, settled boolean, moments array<double>"

    def first(row: dict) -> Iterator[tuple]:
        seen = seen_of(row)
        yield row["key"], row["chunk"], moments(np.ones((len(seen), 1)), seen).ravel().tolist()

    def one_state(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        m = np.sum([r[1] for r in rows], axis=0).reshape(10, 1)
        params = estimates(m)
        if usable(params):
            yield *key, 1, params.ravel().tolist(), [1.0], entropy(m), [1.0], 0, True, m.ravel().tolist()

    def across(row: dict) -> Iterator[tuple]:
        p = likelihoods(np.array(row["params"]).reshape(-1, 7), seen_of(row))
        ahead, back = crossing_matrices(p, _square(row["moves"]))
        yield row["key"], row["chunk"], ahead.ravel().tolist(), back.ravel().tolist()

    def ends(key: tuple, rows: list[tuple]) -> list[tuple]:
        m = len(_square(rows[0][1]))
        before, after = [np.full(m, 1 / m)], [np.ones(m)]
        for _, ahead, _ in rows:
            before.append(normal(_square(ahead) @ before[-1]))
        for _, _, back in reversed(rows):
            after.append(normal(_square(back) @ after[-1]))
        return [(*key, r[0], b.tolist(), a.tolist()) for r, b, a in zip(rows, before, after[-2::-1])]

    def add_up(row: dict) -> Iterator[tuple]:
        seen = seen_of(row)
        rel = posteriors(likelihoods(np.array(row["params"]).reshape(-1, 7), seen), _square(row["moves"]), np.array(row["before"]), np.array(row["after"]))
        yield row["key"], row["chunk"], row["states"], row["params"], row["moves"], row["rounds"], moments(rel, seen).ravel().tolist()

    def update(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        _, states, params, moves, rounds, _ = rows[0]
        m = np.sum([r[5] for r in rows], axis=0).reshape(10, states)
        fit = Fit(np.array(params).reshape(-1, 7), _square(moves), rounds)
        fit.add(m)
        yield *key, states, fit.params.ravel().tolist(), moves, entropy(m), (m[0] / m[0].sum()).tolist(), fit.rounds, fit.settled, m.ravel().tolist()

    def edges(row: dict) -> Iterator[tuple]:
        p = likelihoods(np.array(row["params"]).reshape(-1, 7), seen_of(row))
        yield row["key"], row["chunk"], row["moves"], pair_sums(p).ravel().tolist(), p[0].tolist(), p[-1].tolist()

    def moved(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        pairs = np.sum([_square(r[2]) for r in rows], axis=0) + sum(np.outer(a[4], b[3]) for a, b in zip(rows, rows[1:]))
        yield *key, new_moves(_square(rows[0][1]), pairs).ravel().tolist()

    def more(row: dict) -> Iterator[tuple]:
        params = begun(np.array(row["params"]).reshape(-1, 7))
        if usable(params):
            n = len(params)
            yield row["key"], n, params.ravel().tolist(), np.array(transition_matrix(tau, step, n)).ravel().tolist(), 0.0, [1 / n] * n, 0, False, []

    firsts = _per_row(chunks, first, f"{shape}, moments array<double>")
    done = cut(by_group(firsts, ["key"], ["chunk"], one_state, model_ddl))
    found = [done.drop("settled", "moments")]
    for _ in range(MOST_STATES - 1):
        active, settled = cut(_per_row(done, more, model_ddl)), None
        while active.limit(1).count():
            joined = chunks.join(active.select("key", "states", "params", "moves", "rounds"), "key")
            at_ends = by_group(_per_row(joined, across, f"{shape}, ahead array<double>, back array<double>"), ["key"], ["chunk"], ends, f"{shape}, before array<double>, after array<double>")
            sums = _per_row(joined.join(at_ends, ["key", "chunk"]), add_up, f"{shape}, states long, params array<double>, moves array<double>, rounds long, moments array<double>")
            after = cut(by_group(sums, ["key"], ["chunk"], update, model_ddl))
            settled = after.where("settled") if settled is None else settled.union(after.where("settled"))
            active = after.where("not settled")
        if settled is None:
            break
        done = cut(settled)
        parts = _per_row(chunks.join(done.select("key", "params", "moves"), "key"), edges, f"{shape}, moves array<double>, pairs array<double>, p0 array<double>, pn array<double>")
        moves = by_group(parts, ["key"], ["chunk"], moved, f"key {kind}, new array<double>")
        found.append(cut(done.join(moves, "key").withColumn("moves", F.col("new")).select("key", *[p.split()[0] for p in MODEL.split(", ")])))
    out = found[0]
    for more_found in found[1:]:
        out = out.union(more_found)
    return out


def fitted_states(df: DataFrame, columns: tuple[str, str, str, str], key: str = "bid", order: str = "frame", tau: float = 20_000.0, step: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """key, states (1 to 3), state, reversal ... cov (``NAMES``), weight, moves (the state's row of transition chances), entropy, rounds.

    columns: reversal, speed, tangential and radial acceleration of rows at equal
    times, ``step`` apart. More states begin as the fit of one fewer with its last
    state twice, one of them faster by one; parameters are estimated anew from the
    rows' chances, with one spread for all states, until they change by 0.1 in
    all; then each state has its own spread, and the transitions are estimated
    once. Series whose states have no spread (of fewer than two rows, or all
    alike) have no fit with as many states or more. Rows with a null are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    chunks = stored(packed(df, columns, key, order, chunk), "series")
    sizes = chunks.groupBy("key").agg(F.count("*").alias("chunks"))
    whole = chunks.join(sizes.where("chunks = 1").select("key"), "key")
    long = chunks.join(sizes.where("chunks > 1").select("key"), "key")

    def each(row: dict) -> Iterator[tuple]:
        return ((row["key"], *f) for f in whole_fits(np.array(row["seen"]).reshape(-1, 4), tau, step))

    found = _per_row(in_tasks(whole, whole.count(), SERIES, "key"), each, f"key {kind}, {MODEL}")
    if long.limit(1).count():
        found = found.union(_long_fits(stored(long, "long-series"), kind, tau, step))
    rows = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("states") - 1)).alias("state"))
    values = [F.get("params", (7 * F.col("state") + i).cast("int")).alias(n) for i, n in enumerate(NAMES)]
    moves = F.slice("moves", (F.col("state") * F.col("states") + 1).cast("int"), F.col("states").cast("int"))
    return rows.select(F.col("key").alias(key), "states", "state", *values, F.get("weights", F.col("state").cast("int")).alias("weight"), moves.alias("moves"), "entropy", "rounds")
