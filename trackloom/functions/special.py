"""Special functions as column expressions: log-gamma, incomplete gamma and beta, the normal distribution.

Each is a number of terms folded inside the row, so it stays in the JVM. Series
and fractions converge in some square roots of their greatest argument, so that
decides the number.
Arguments outside a function's domain give null, and so do nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
#: Of Stirling's series: B(2k) / (2k (2k - 1)) for k = 1, 2, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
SHIFT = 8


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 8, less the logarithms of the eight steps back."""
    big = z + SHIFT
    series = (big - 0.5) * F.log(big) - big + 0.5 * math.log(2 * math.pi)
    power = big
    for c in STIRLING:
        series, power = series + c / power, power * big * big
    steps = z
    for k in range(1, SHIFT):
        steps = steps * (z + k)
    return F.when(z > 0, series - F.log(steps))


def _terms(largest: Column, least: int, by_root: int) -> Column:
    """1, 2, ...: as many terms as arguments up to ``largest`` need."""
    return F.sequence(F.lit(1), (least + by_root * F.ceil(F.sqrt(F.coalesce(F.greatest(largest, F.lit(0.0)), F.lit(0.0))))).cast("int"))


def gamma_p_series(a: Column, x: Column) -> Column:
    """The lower incomplete gamma function, regularised, by its power series; for x < a + 1."""
    one = F.lit(1.0) / a
    state = F.aggregate(_terms(a, 40, 9), F.struct(one.alias("sum"), one.alias("term")), lambda s, n: F.struct((s.sum + s.term * x / (a + n)).alias("sum"), (s.term * x / (a + n)).alias("term")))
    return F.when(x == 0, 0.0).otherwise(state.sum * F.exp(-x + a * F.log(x) - log_gamma(a)))


def gamma_q_fraction(a: Column, x: Column) -> Column:
    """The upper one by its continued fraction (Lentz's way); for x >= a + 1."""
    b0 = x + 1.0 - a
    start = F.struct(b0.alias("b"), F.lit(1 / TINY).alias("c"), (1.0 / b0).alias("d"), (1.0 / b0).alias("h"))

    def step(s, n):
        an, b = -n * (n - a), s.b + 2.0
        d, c = 1.0 / (an * s.d + b), b + an / s.c
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s.h * d * c).alias("h"))

    return F.aggregate(_terms(a, 80, 4), start, step).h * F.exp(-x + a * F.log(x) - log_gamma(a))


def gamma_p(a: Column, x: Column) -> Column:
    """P(a, x) for a > 0, x >= 0."""
    return F.when((a > 0) & (x >= 0), F.when(x < a + 1, gamma_p_series(a, x)).otherwise(1.0 - gamma_q_fraction(a, x)))


def gamma_q(a: Column, x: Column) -> Column:
    """1 - P(a, x), without loss of small values."""
    return F.when((a > 0) & (x >= 0), F.when(x < a + 1, 1.0 - gamma_p_series(a, x)).otherwise(gamma_q_fraction(a, x)))


def normal_pdf(x: Column, mean=0.0, spread=1.0) -> Column:
    z = (x - mean) / spread
    return F.exp(-z * z / 2) / (spread * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean=0.0, spread=1.0) -> Column:
    z = (x - mean) / spread
    return 0.5 + 0.5 * F.signum(z) * gamma_p(F.lit(0.5), z * z / 2)


def chi_square_q(chi_square: Column, freedom: Column) -> Column:
    """The probability of a larger chi-square."""
    return gamma_q(freedom / 2, chi_square / 2)


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 and 0 <= x <= 1, by its continued fraction on the side where that converges fast."""

    def fraction(a, b, x):
        safe = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
        d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def half(s, k):
            d, c = 1.0 / safe(1.0 + k * s.d), safe(1.0 + k / s.c)
            return F.struct(c.alias("c"), d.alias("d"), (s.h * d * c).alias("h"))

        even = F.aggregate(  # both halves of a step, one after the other
            F.flatten(F.transform(_terms(F.greatest(a, b), 40, 4), lambda m: F.array(m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m)), -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))))),
            start, half,
        )
        return even.h

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    inside = F.when(x < (a + 1.0) / (a + b + 2.0), front * fraction(a, b, x) / a).otherwise(1.0 - front * fraction(b, a, 1.0 - x) / b)
    return F.when((a > 0) & (b > 0) & (x >= 0) & (x <= 1), F.when(x == 0, 0.0).when(x == 1, 1.0).otherwise(inside))


def f_test_p(f: Column, n1: Column, n2: Column) -> Column:
    """The probability of a larger F with n1 and n2 degrees of freedom."""
    return F.when(f >= 0, beta_i(n2 / 2, n1 / 2, n2 / (n2 + n1 * f)))


def hamming(a: Column, b: Column) -> Column:
    """How many places of two arrays differ; those that only one has count."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
