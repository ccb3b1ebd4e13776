"""Outlier thresholds from fitted normal distributions, flags of several kinds, smoothing windows, resampling and decay fits."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """keys, bin (from 0), middle, n over ``bins`` equal spans between a key's least and greatest value; one value is one bin."""
    keys = keys or []
    ends = df.groupBy(*keys).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    rows = df.where(F.col(column).isNotNull())
    rows = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.least(F.floor(F.try_divide(F.col(column) - F.col("_low"), width)), F.lit(bins - 1).cast("long"))
    rows = rows.withColumn("bin", F.coalesce(place, F.lit(0).cast("long"))).withColumn("middle", F.col("_low") + (F.col("bin") + 0.5) * width)
    return rows.groupBy(*keys, "bin", "middle").agg(F.count("*").alias("n"))


def fit_normal(middles: np.ndarray, heights: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(mean, deviation) of the normal density that fits normalised bar heights best (least squares, damped Gauss-Newton)."""
    if len(middles) < 3:
        return (float(middles[heights.argmax()]) if len(middles) else 0.0), 1.0
    width = np.diff(np.sort(middles)).min()
    h = heights / (heights.sum() * width)
    weight = heights / heights.sum()
    mean = float((weight * middles).sum())
    std = float(np.sqrt((weight * (middles - mean) ** 2).sum())) or 1.0
    damp = 1e-3
    for _ in range(rounds):
        z = (middles - mean) / std
        f = np.exp(-z * z / 2) / (std * np.sqrt(2 * np.pi))
        jac = np.stack([f * z / std, f * (z * z - 1) / std], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.diag((jac * jac).sum(axis=0) + 1e-12), jac.T @ (h - f))
        new = mean + step[0], max(std + step[1], 1e-9)
        z2 = (middles - new[0]) / new[1]
        if ((h - np.exp(-z2 * z2 / 2) / (new[1] * np.sqrt(2 * np.pi))) ** 2).sum() < ((h - f) ** 2).sum():
            mean, std, damp = float(new[0]), float(new[1]), damp / 3
        else:
            damp *= 4
    return mean, std


def extreme_thresholds(mean: float, std: float, n: int, p: float = 0.05) -> tuple[float, float]:
    """Bounds that the least and greatest of n normal values pass with probability p each."""
    if n < 1 or std <= 0:
        return mean, mean
    z = NormalDist().inv_cdf((1 - p) ** (1 / n))
    return mean - z * std, mean + z * std


def outlier_flags(df: DataFrame, column: str, bins: int = 200, p: float = 0.05, least_valid: float = 0.5) -> DataFrame:
    """ok_short, ok_long, ok: is a value inside the fitted extremes? False for null and NaN; all false where fewer than ``least_valid`` of the values are valid and not zero."""
    v = F.col(column)
    valid = v.isNotNull() & ~F.isnan(v)
    n, good, used = df.agg(F.count("*"), F.count_if(valid & (v != 0)), F.count_if(valid)).first()
    bars = histogram(df.where(valid), column, bins).orderBy("bin").collect()  # at most ``bins`` rows
    mean, std = fit_normal(np.array([b.middle for b in bars], dtype=float), np.array([b.n for b in bars], dtype=float))
    low, high = extreme_thresholds(mean, std, used, p)
    enough = F.lit(bool(n and good >= least_valid * n))
    short, long = F.coalesce(enough & valid & (v >= low), F.lit(False)), F.coalesce(enough & valid & (v <= high), F.lit(False))
    return df.withColumns({"ok_short": short, "ok_long": long, "ok": short & long})


def all_flags(*flags: str) -> Column:
    """True where every flag is; a null flag is false."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])


def flag_counts(df: DataFrame, flags: list[str], key: str = "bid") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])


WINDOWS = {
    "boxcar": lambda n: np.ones(n),
    "bartlett": np.bartlett,
    "hann": np.hanning,
    "hamming": np.hamming,
    "blackman": np.blackman,
    "triang": lambda n: 1 - np.abs(np.arange(n) - (n - 1) / 2) / ((n + 1) / 2),
    "cosine": lambda n: np.sin(np.pi * (np.arange(n) + 0.5) / n),
}


def window_smooth(df: DataFrame, column: str, window: str, width: int, key: str = "bid", order: str = "frame") -> DataFrame:
    """smooth: weighted mean over a centred window (odd width) of one of ``WINDOWS``; null where it isn't full."""
    weights = WINDOWS[window](width)
    weights = weights / weights.sum()
    w = Window.partitionBy(key).orderBy(order)
    half = width // 2
    at = lambda k: F.lag(column, -k).over(w) if k < 0 else F.lead(column, k).over(w)
    parts = [F.lit(float(c)) * (F.col(column) if k == 0 else F.lag(column, -k).over(w) if k < 0 else at(k)) for k, c in zip(range(-half, half + 1), weights)]
    return df.withColumn("smooth", sum(parts[1:], parts[0]))


def resample(points: Column, n: int) -> Column:
    """n points at equal distances along a polyline (struct<x, y>), its ends included; null for fewer than two points or no length."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.hypot(q.x - p.x, q.y - p.y))
    run = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
    total = F.element_at(run, -1)

    def at(k: Column) -> Column:
        goal = total * k / (n - 1)
        i = F.least(F.greatest(F.size(F.filter(run, lambda r: r <= goal)), F.lit(1)), F.size(points) - 1)
        p, q = F.element_at(points, i), F.element_at(points, i + 1)
        part = F.coalesce(F.try_divide(goal - F.element_at(run, i), F.element_at(run, i + 1) - F.element_at(run, i)), F.lit(0.0))
        return F.struct((p.x + part * (q.x - p.x)).alias("x"), (p.y + part * (q.y - p.y)).alias("y"))

    return F.when((F.size(points) > 1) & (total > 0), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def decay_fit(df: DataFrame, column: str, minute: str, key: str | None = None) -> DataFrame:
    """rate, start, n of column = start * exp(-rate * minute) by regression on logarithms of the minutes' means; means of 0 or less are left out."""
    keys = [key] if key else []
    means = df.groupBy(*keys, F.floor(minute).alias("m")).agg(F.avg(column).alias("v")).where("v > 0").withColumn("l", F.ln("v"))
    return means.groupBy(*keys).agg((-F.regr_slope("l", "m")).alias("rate"), F.exp(F.regr_intercept("l", "m")).alias("start"), F.count("*").alias("n"))


def image_scores(objects: DataFrame, ground: DataFrame, image: str) -> DataFrame:
    """image, dark (5th percentile of the object's pixels), ground (mean), contrast; pixels as rows (image, value)."""
    dark = objects.groupBy(image).agg(F.percentile("value", 0.05).alias("dark"))
    back = ground.groupBy(image).agg(F.avg("value").alias("ground"))
    return dark.join(back, image).withColumn("contrast", F.col("ground") - F.col("dark"))


def head_and_tail(rows: DataFrame, order: str, key: str, columns: list[str]) -> DataFrame:
    """A key's first and last row by order."""
    s = F.struct(order, *columns)
    out = rows.groupBy(key).agg(F.min(s).alias("head"), F.max(s).alias("tail"))
    return out.select(key, *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("head", "tail") for c in (order, *columns)])


def flip_parity(flips: str, key: str = "bid", order: str = "frame") -> Column:
    """True in rows after an odd number of flips."""
    return F.sum(F.coalesce(F.col(flips), F.lit(False)).cast("int")).over(Window.partitionBy(key).orderBy(order)) % 2 == 1
