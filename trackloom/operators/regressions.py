"""Regressions and slope comparisons by group, and synthetic piecewise series.

Sums of squares are aggregates with partial sums before the shuffle; groups with
too few rows give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.special import f_test_p


def regressions(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept, r2 of y on x; null values are left out."""
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def _logs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Logarithms; rows without them go."""
    for c in columns:
        df = df.where(F.col(c) > 0).withColumn(c, F.log(c))
    return df


def log_linear(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = factor * exp(slope * x): keys, n, slope, factor, r2."""
    return regressions(_logs(df, [y]), keys, x, y).withColumn("factor", F.exp("intercept")).drop("intercept")


def log_log(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = factor * x ** slope: keys, n, slope, factor, r2."""
    return regressions(_logs(df, [x, y]), keys, x, y).withColumn("factor", F.exp("intercept")).drop("intercept")


def slope_sums(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, sxx, syy, sxy: sums of squares and products about the means."""
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))


def compare_slopes(sums: DataFrame, key: str, part: str) -> DataFrame:
    """key, part, f, p of the test that a part and the next have one slope (analysis of covariance, intercepts free)."""
    nxt = sums.select(key, (F.col(part) - 1).alias(part), *[F.col(c).alias(f"{c}2") for c in ("n", "sxx", "syy", "sxy")])
    both = sums.join(nxt, [key, part])
    rest = lambda a, b, c: b - F.try_divide(c * c, a)
    apart = rest(F.col("sxx"), F.col("syy"), F.col("sxy")) + rest(F.col("sxx2"), F.col("syy2"), F.col("sxy2"))
    together = rest(F.col("sxx") + F.col("sxx2"), F.col("syy") + F.col("syy2"), F.col("sxy") + F.col("sxy2"))
    free = F.col("n") + F.col("n2") - 4
    f = F.when(free > 0, F.try_divide(F.greatest(together - apart, F.lit(0.0)) * free, apart))
    return both.select(key, part, f.alias("f"), free.cast("double").alias("free")).withColumn("p", f_test_p(F.col("f"), F.lit(1.0), F.col("free"))).drop("free")


def unit_noise(seed: Column) -> Column:
    """A number in (0, 1) from an integer: a fixed linear congruence, twice."""
    step = lambda v: F.pmod(v * 1103515245 + 12345, F.lit(2**31))
    return (step(step(seed.cast("long"))) + 0.5) / 2**31


def gaussian_noise(seed: Column) -> Column:
    """A normal number from an integer (Box and Muller's way)."""
    return F.sqrt(-2 * F.log(unit_noise(2 * seed))) * F.cos(2 * math.pi * unit_noise(2 * seed + 1))


def piecewise_series(series: DataFrame, key: str, points: int, breaks: list[int], slopes: list[float]) -> DataFrame:
    """key, x (0 ... points - 1), y: a continuous line of the given slopes, which change at ``breaks``."""
    x = F.col("x")
    y = slopes[0] * x
    for at, a, b in zip(breaks, slopes, slopes[1:]):
        y = y + (b - a) * F.greatest(x - at, F.lit(0))
    return series.select(key, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("x")).withColumn("y", y.cast("double"))


def corrupted(df: DataFrame, columns: list[str], spread: float, seed: Column) -> DataFrame:
    """``columns`` with normal noise of ``spread``; ``seed``: an integer of the row's own."""
    return df.withColumns({c: F.col(c) + spread * gaussian_noise(seed + 1_000_003 * k) for k, c in enumerate(columns)})


def join_breaks(breaks: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Break points without the ones that are taken back."""
    return breaks.join(gone.select(*keys), keys, "left_anti")


def fitted_lines(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A line of text for each part: its ends and the fitted values there."""
    fit = df.groupBy(*keys).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).where("slope IS NOT NULL")
    at = lambda c: F.format_string("%.3f", F.col(c) * F.col("slope") + F.col("intercept"))
    return fit.select(*keys, F.format_string("%.6f", "slope").alias("slope"), F.concat_ws(" ", F.format_string("%.3f", F.col("a").cast("double")), at("a"), F.format_string("%.3f", F.col("b").cast("double")), at("b")).alias("line"))
