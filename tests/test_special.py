"""Special functions of small and large arguments against exact sums."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trackloom.functions import special


def poisson_tail(n, x):
    return math.fsum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(n))


def binomial_tail(a, b, x):
    n = a + b - 1
    return float(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)))


def test_gamma_of_whole_numbers(spark):
    cases = [(float(n), n * f) for n in (1, 2, 7, 40, 300, 1000, 5000) for f in (0.6, 0.97, 0.999, 1.001, 1.03, 1.8)]
    rows = spark.createDataFrame(cases, "a double, x double").select("a", "x", special.gamma_p(F.col("a"), F.col("x")).alias("p"), special.gamma_q(F.col("a"), F.col("x")).alias("q")).collect()
    for r in rows:
        want = poisson_tail(int(r.a), r.x)
        assert r.q == pytest.approx(want, rel=1e-8, abs=1e-12) and r.p == pytest.approx(1 - want, rel=1e-8, abs=1e-11), r


def test_beta_of_whole_numbers(spark):
    cases = [(float(a), float(b), k / 16) for a in (1, 2, 9, 60, 400) for b in (1, 3, 30, 500) for k in (1, 5, 8, 11, 15)]
    cases += [(float(a), float(b), round(16 * a / (a + b)) / 16) for a, b in ((900, 900), (1500, 500))]
    rows = spark.createDataFrame(cases, "a double, b double, x double").select("a", "b", "x", special.beta_i(F.col("a"), F.col("b"), F.col("x")).alias("v")).collect()
    for r in rows:
        assert r.v == pytest.approx(binomial_tail(int(r.a), int(r.b), Fraction(r.x)), rel=1e-7, abs=1e-11), r


def test_arguments_outside_give_null(spark):
    rows = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (-4.0, 1.0), (1.0, -1.0), (1.0, None)], "a double, x double")
    got = rows.select(special.gamma_p(F.col("a"), F.col("x")), special.gamma_q(F.col("a"), F.col("x")), special.beta_i(F.col("a"), F.lit(1.0), F.col("x"))).collect()
    assert all(v is None for r in got for v in r)
