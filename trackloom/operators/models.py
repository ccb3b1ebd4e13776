"""Per-series models: smoothing weights, hidden states, segments; clustering in parts.

Grouped functions get one track at a time: their keys are an object and its
segment, which ends at the first pause. An object that is seen without a pause
for ever needs a cut by time first (``series.tumbling_bins``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.batches import by_group
from trackloom.plans.lineage import cut


def savgol_weights(width: int, order: int) -> list[float]:
    """Weights of the value at the centre of a least-squares polynomial over ``width`` (odd) points."""
    half = width // 2
    powers = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    return np.linalg.pinv(powers)[0].tolist()


def savgol(df: DataFrame, column: str, width: int, order: int, key: str | tuple[str, ...] = "bid", by: str = "frame") -> DataFrame:
    """smooth: Savitzky-Golay filter inside the database engine; ends are padded by reflection at the first and last value.

    A missing neighbour k rows before the first value y0 is y0 - |y_k - y0|, after the last it is yN + |y_k - yN|.
    """
    half, keys = width // 2, [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(by)
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w)
    first, last = F.first(column).over(w), F.last(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumns({"_n": n, "_i": i, "_first": first, "_last": last})
    around = F.collect_list(F.struct(F.col(column).cast("double").alias("v"))).over(w.rowsBetween(-width, width))
    df = df.withColumn("_around", F.when(F.col("_n") > half, around))
    begin = F.greatest(F.col("_i") - width, F.lit(1))  # the row that the first element is of
    at = lambda j: F.get("_around", (j - begin).cast("int")).v

    def value(k: Column):
        j = F.col("_i") + k
        low = F.col("_first") - F.abs(at(2 - j) - F.col("_first"))
        high = F.col("_last") + F.abs(at(2 * F.col("_n") - j) - F.col("_last"))
        return F.when(j < 1, low).when(j > F.col("_n"), high).otherwise(at(j))

    weights = F.array(*map(F.lit, savgol_weights(width, order)))
    parts = F.zip_with(F.transform(F.sequence(F.lit(-half), F.lit(half)), value), weights, lambda v, c: c * v)
    total = F.aggregate(parts, F.lit(0.0), lambda done, v: done + v)
    return df.withColumn("smooth", total).drop("_n", "_i", "_first", "_last", "_around")


def forward_backward(likelihood: np.ndarray, change: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state probabilities of each row, expected transitions); likelihood: rows x states."""
    n, m = likelihood.shape
    a, b, scale = np.zeros((n, m)), np.ones((n, m)), np.zeros(n)
    a[0] = start * likelihood[0]
    for t in range(n):
        if t:
            a[t] = (a[t - 1] @ change) * likelihood[t]
        scale[t] = a[t].sum() or 1e-300
        a[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = change @ (likelihood[t + 1] * b[t + 1]) / scale[t + 1]
    g = a * b
    g /= g.sum(axis=1, keepdims=True)
    moves = sum((np.outer(a[t], likelihood[t + 1] * b[t + 1]) * change / scale[t + 1] for t in range(n - 1)), np.zeros((m, m)))
    return g, moves


def fit_states(x: np.ndarray, states: int = 2, rounds: int = 20) -> np.ndarray:
    """The most likely state of each value under a Gaussian hidden Markov model; states are numbered by rising mean."""
    if len(x) < 2 * states or np.ptp(x) == 0:
        return np.zeros(len(x), dtype=np.int64)
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    std = np.full(states, x.std() / states + 1e-9)
    change = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(change, 0.9)
    start = np.full(states, 1 / states)
    for _ in range(rounds):
        density = np.exp(-0.5 * ((x[:, None] - mean) / std) ** 2) / std + 1e-300
        g, moves = forward_backward(density, change, start)
        weight = g.sum(axis=0) + 1e-12
        mean = (g * x[:, None]).sum(axis=0) / weight
        std = np.sqrt((g * (x[:, None] - mean) ** 2).sum(axis=0) / weight) + 1e-3 * x.std()
        change = (moves + 1e-6) / (moves + 1e-6).sum(axis=1, keepdims=True)
        start = g[0]
    rank = np.empty(states, dtype=np.int64)
    rank[np.argsort(mean, kind="stable")] = np.arange(states)
    return rank[g.argmax(axis=1)]


def _by_track(df: DataFrame, column: str, keys: tuple[str, ...], by: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(*keys, F.col(by).cast("long").alias("_by"), F.col(column).cast("double").alias("_v"))


def _kinds(df: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def hidden_states(df: DataFrame, column: str, states: int = 2, keys: tuple[str, ...] = ("bid", "segment"), by: str = "frame") -> DataFrame:
    """keys, by, state of each row with a value; many tracks share a task."""

    def each(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        at, values = zip(*rows)
        return ((*key, i, int(s)) for i, s in zip(at, fit_states(np.array(values), states)))

    return by_group(_by_track(df, column, keys, by), list(keys), ["_by"], each, f"{_kinds(df, keys)}, `{by}` long, state long")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return f - 1


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a * _betacf(a, b, x)


def t_max_p(t: float, n: int) -> float:
    """How likely the largest t over all cuts of n values is at least t without a change."""
    nu, eta = n - 2, 4.19 * np.log(n) - 11.54
    if eta <= 0:
        return 1.0
    return float(1 - (1 - beta_inc(0.40 * nu, 0.40, nu / (nu + t * t))) ** eta)


def cut_t(x: np.ndarray, at: int) -> float:
    """|t| of the means on both sides of a cut, with the pooled deviation."""
    a, b = x[:at], x[at:]
    pooled = ((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(x) - 2)
    gap = abs(a.mean() - b.mean())
    return gap / np.sqrt(pooled * (1 / len(a) + 1 / len(b))) if pooled > 0 else (np.inf if gap > 0 else 0.0)


def best_cut(part: np.ndarray, least: int) -> tuple[int, float]:
    """(length of the left side, t) of the cut with the largest t of the means; (0, 0) if there is none."""
    n = len(part)
    if n < 2 * least:
        return 0, 0.0
    cuts = np.arange(least, n - least + 1)
    s, q = np.cumsum(part)[cuts - 1], np.cumsum(part * part)[cuts - 1]
    total, square = part.sum(), (part * part).sum()
    va, vb = q / cuts - (s / cuts) ** 2, (square - q) / (n - cuts) - ((total - s) / (n - cuts)) ** 2
    pooled = np.maximum(((cuts - 1) * va + (n - cuts - 1) * vb) / (n - 2), 1e-18)
    t = np.abs(s / cuts - (total - s) / (n - cuts)) / np.sqrt(pooled * (1 / cuts + 1 / (n - cuts)))
    return int(cuts[t.argmax()]), float(t.max())


def slopes_differ(x: np.ndarray, y: np.ndarray, at: int) -> float:
    """How likely slopes as different as those of y on x on both sides of a cut are with one slope (analysis of covariance); 1 where a side has no spread in x."""
    def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        u, v = a - a.mean(), b - b.mean()
        return np.array([(u * u).sum(), (v * v).sum(), (u * v).sum()])

    left, right = sums(x[:at], y[:at]), sums(x[at:], y[at:])
    free = len(x) - 4
    if free < 1 or left[0] <= 0 or right[0] <= 0:
        return 1.0
    xx, yy, xy = left + right
    effect = left[2] ** 2 / left[0] + right[2] ** 2 / right[0] - xy * xy / xx
    error = yy - xy * xy / xx - effect
    if error <= 0:
        return 0.0 if effect > 1e-12 * max(yy, 1e-300) else 1.0
    return beta_inc(free / 2, 0.5, free / (free + max(effect, 0.0) / error * free))


def segment(x: np.ndarray, least: int = 6, p: float = 0.05, also: Callable[[int, int, int], bool] | None = None) -> list[int]:
    """Starts of the segments of one level each.

    A segment is cut where the t of the means is largest if that is significant
    and, with the cut, so are the differences to both neighbours, and if
    ``also(start, cut, end)`` holds. From the first segment on, until none can be
    cut any more; after a cut it begins again, since neighbours have changed.
    """
    starts, failed, k = [0], set(), 0
    while k < len(starts):
        low, high = starts[k], starts[k + 1] if k + 1 < len(starts) else len(x)
        left, right = starts[k - 1] if k else low, starts[k + 2] if k + 2 < len(starts) else len(x)
        if (left, low, high, right) not in failed:
            size, t = best_cut(x[low:high], least)
            at = low + size
            good = size > 0 and t_max_p(t, high - low) < p
            good = good and (left == low or t_max_p(cut_t(x[left:at], low - left), at - left) < p)
            good = good and (right == high or t_max_p(cut_t(x[at:right], high - at), right - at) < p)
            if good and (also is None or also(low, at, high)):
                starts.insert(k + 1, at)
                k = 0
                continue
            failed.add((left, low, high, right))
        k += 1
    return starts


def segments(df: DataFrame, column: str, keys: tuple[str, ...] = ("bid", "segment"), by: str = "frame", least: int = 6, p: float = 0.05) -> DataFrame:
    """keys, first and last order value, n and mean of each stretch of a track with one level; many tracks share a task."""

    def each(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        at, values = zip(*rows)
        x = np.array(values)
        cuts = [*segment(x, least, p), len(x)]
        return ((*key, at[a], at[b - 1], b - a, float(x[a:b].mean())) for a, b in zip(cuts, cuts[1:]))

    return by_group(_by_track(df, column, keys, by), list(keys), ["_by"], each, f"{_kinds(df, keys)}, first long, last long, n long, mean double")


def slope_segments(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("bid", "segment"), by: str = "frame", least: int = 6, p: float = 0.05) -> DataFrame:
    """keys, first and last order value, n, mean, slope: stretches of y that differ in level and in their slope on x.

    As ``segments``, but a cut is taken back where both sides could have one slope.
    slope: null for a stretch without spread in x. Rows without x or y are left out.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(by).cast("long").alias("_by"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_v"))

    def each(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        at, xs, ys = (np.array(c) for c in zip(*group))
        cuts = [*segment(ys, least, p, lambda a, c, b: slopes_differ(xs[a:b], ys[a:b], c - a) < p), len(ys)]
        for a, b in zip(cuts, cuts[1:]):
            u = xs[a:b] - xs[a:b].mean()
            slope = float((u * ys[a:b]).sum() / (u * u).sum()) if (u * u).sum() > 0 else None
            yield *key, int(at[a]), int(at[b - 1]), b - a, float(ys[a:b].mean()), slope

    return by_group(rows, list(keys), ["_by"], each, f"{_kinds(df, keys)}, first long, last long, n long, mean double, slope double")


def scattered(points: np.ndarray, mean: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` points far from the mean and from each other."""
    d = np.linalg.norm(points - mean, axis=1)
    picked = [int(d.argmax())]
    while len(picked) < min(most, len(points)):
        d = np.min([np.linalg.norm(points - points[k], axis=1) for k in picked], axis=0)
        picked.append(int(d.argmax()))
    return points[picked]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cure_merge(points: list[np.ndarray], means: np.ndarray, sizes: np.ndarray, clusters: int, reps: int = 3, shrink: float = 0.5) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(scattered points, mean, size) of each cluster: merges the two whose representatives are nearest on average by cosine, until ``clusters`` are left.

    Representatives are the scattered points moved by ``shrink`` towards the mean.
    """
    points, means, sizes = list(points), means.astype(float).copy(), sizes.copy()
    facing = lambda k: unit(points[k] + shrink * (means[k] - points[k])).mean(axis=0)
    centre = np.array([facing(k) for k in range(len(points))])
    alike = centre @ centre.T
    np.fill_diagonal(alike, -np.inf)
    alive = list(range(len(points)))
    while len(alive) > clusters:
        sub = alike[np.ix_(alive, alive)]
        i, j = sorted(alive[k] for k in np.unravel_index(sub.argmax(), sub.shape))
        means[i] = (sizes[i] * means[i] + sizes[j] * means[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        points[i] = scattered(np.concatenate([points[i], points[j]]), means[i], reps)
        alive.remove(j)
        centre[i] = facing(i)
        alike[i, :] = alike[:, i] = centre @ centre[i]
        alike[i, i] = -np.inf
    return [(points[k], means[k], int(sizes[k])) for k in alive]


def cure(df: DataFrame, vector: str, clusters: int, id_col: str, part_rows: int = 400, partial: int = 5, shrink: float = 0.5) -> DataFrame:
    """id, cluster of every row: CURE over all rows, in parts.

    Parts of about ``part_rows`` rows are merged down to ``partial`` times as many
    clusters as wanted, each kept as its scattered points, mean and size; these
    meet in parts again until one part is left, which is merged to ``clusters``.
    Then each row goes to its nearest representative. No task has more than a
    part, and the rounds grow with the logarithm of the rows.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = "points array<array<double>>, mean array<double>, n long"
    now, count = rows.select(F.array("v").alias("points"), F.col("v").alias("mean"), F.lit(1).cast("long").alias("n"), F.xxhash64("id").alias("hash")), rows.count()
    if not count:
        return rows.select("id", F.lit(0).alias("cluster")).toDF(id_col, "cluster")

    def merged(wanted: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            found = cure_merge([np.array([list(p) for p in ps]) for ps in pdf["points"]], np.array([list(m) for m in pdf["mean"]]), pdf["n"].to_numpy(), wanted, shrink=shrink)
            return pd.DataFrame([(p.tolist(), m.tolist(), n) for p, m, n in found], columns=["points", "mean", "n"])

        return one

    while True:
        parts = -(-count // part_rows)
        now = now.withColumn("part", F.pmod("hash", F.lit(parts)))
        now = cut(now.groupBy("part").applyInPandas(merged(clusters if parts == 1 else clusters * partial), schema).withColumn("hash", F.xxhash64("mean", "n")))
        count = now.count()
        if parts == 1:
            break
    centres = [(np.array([list(p) for p in r.points]), np.array(r["mean"])) for r in now.orderBy(F.desc("n"), "hash").collect()]  # as many as clusters
    flat = unit(np.concatenate([p + shrink * (m - p) for p, m in centres]))
    owner = np.repeat(np.arange(len(centres)), [len(p) for p, _ in centres])

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "cluster": owner[(np.stack(pdf["v"].to_list()) @ flat.T).argmax(axis=1)].astype(np.int32)})

    return rows.mapInPandas(assign, f"id {kind}, cluster int").toDF(id_col, "cluster")


def bootstrap_exponential(df: DataFrame, column: str, key: str, samples: int, share: float, seed: int = 1) -> DataFrame:
    """key, sample, scale, n, ks: random samples of each series, the scale of the exponential fitted to each (its mean), and how far the sample is from that."""
    rows = df.where(F.col(column) >= 0).select(key, column, F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    drawn = cut(rows.where(F.rand(seed) < share))
    sizes = drawn.groupBy(key, "sample").agg(F.count("*").alias("n"))
    return sizes.join(exponential_ks(drawn, column, key, "sample"), [key, "sample"]).select(key, "sample", "scale", "n", "ks")


def exponential_ks(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, scale, ks: distance of a series' distribution function from the exponential with its mean."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(column) >= 0).withColumns({"_scale": F.avg(column).over(w), "_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(column))})
    p = 1 - F.exp(F.try_divide(-F.col(column), F.col("_scale")))
    far = F.greatest(F.abs(F.col("_i") / F.col("_n") - p), F.abs((F.col("_i") - 1) / F.col("_n") - p))
    return rows.groupBy(*keys, F.col("_scale").alias("scale")).agg(F.max(far).alias("ks"))
