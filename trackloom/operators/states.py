"""States of motion by heavy-tailed likelihoods: what a state expects of reversals, speed and both accelerations.

``params``: a state's chance of a reversal, means of speed and tangential
acceleration, variances of speed, tangential and radial acceleration, and the
covariance of speed and tangential acceleration (``NAMES``). Numbers of states
are small and fixed, so states are columns and everything stays in the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("reversal", "speed", "along", "var_speed", "var_along", "var_radial", "cov")


def transition_matrix(tau: float = 10, step: float = 0.1, states: int = 3) -> list[list[float]]:
    """Chances to go from state to state within ``step`` when a state lasts ``tau`` on average and all others are alike: the exponential of that rate matrix, in closed form."""
    if states == 1:
        return [[1.0]]
    fades = math.exp(-step * states / ((states - 1) * tau))
    return [[(1 - fades) / states + (fades if i == j else 0.0) for j in range(states)] for i in range(states)]


def observation_probability(params: dict[str, float | Column], reversal: Column, speed: Column, along: Column, radial: Column) -> Column:
    """Chance of a reversal (or none) times a density that falls with the sixth power of the Mahalanobis distance; null where the covariance matrix has no positive determinant."""
    p = {k: params[k] if isinstance(params[k], Column) else F.lit(float(params[k])) for k in NAMES}
    s, a = speed - p["speed"], along - p["along"]
    plane = p["var_speed"] * p["var_along"] - p["cov"] * p["cov"]
    det = plane * p["var_radial"]
    square = F.try_divide(p["var_along"] * s * s - 2 * p["cov"] * s * a + p["var_speed"] * a * a, plane) + F.try_divide(radial * radial, p["var_radial"])
    chance = F.when(reversal, p["reversal"]).otherwise(1 - p["reversal"])
    return F.when(det > 0, chance * 4 / (math.pi**2 * F.sqrt(det)) / F.pow(1 + square, F.lit(3.0)))


def state_probabilities(df: DataFrame, states: list[dict[str, float]], reversal: str, speed: str, along: str, radial: str) -> DataFrame:
    """``df`` with p0, p1, ...: each state's share of the likelihood of a row by itself."""
    found = [observation_probability(s, *[F.col(c) for c in (reversal, speed, along, radial)]) for s in states]
    df = df.withColumns({f"_l{k}": v for k, v in enumerate(found)})
    total = sum((F.col(f"_l{k}") for k in range(1, len(states))), F.col("_l0"))
    return df.withColumns({f"p{k}": F.try_divide(F.col(f"_l{k}"), total) for k in range(len(states))}).drop(*[f"_l{k}" for k in range(len(states))])


def estimated_states(df: DataFrame, states: int, reversal: str, speed: str, along: str, radial: str) -> DataFrame:
    """state and its parameters (``NAMES``), from rows with p0, p1, ...: weighted means, and variances with the weights' correction."""
    r, s, a, ar = F.col(reversal).cast("double"), F.col(speed), F.col(along), F.col(radial)
    parts = []
    for k in range(states):
        p = F.col(f"p{k}")
        sums = [F.sum(p), F.sum(p * p), F.sum(p * r), F.sum(p * s), F.sum(p * a), F.sum(p * s * s), F.sum(p * a * a), F.sum(p * ar * ar), F.sum(p * a * s)]
        parts.append(F.struct(F.lit(k).alias("state"), *[v.alias(f"m{i}") for i, v in enumerate(sums)]).alias(f"_{k}"))
    rows = df.agg(*parts).select(F.explode(F.array(*[f"_{k}" for k in range(states)])).alias("m")).select("m.*")
    mean = lambda i: F.try_divide(F.col(f"m{i}"), F.col("m0"))
    more = F.try_divide(F.lit(1.0), 1 - F.try_divide(F.col("m1"), F.col("m0") * F.col("m0")))
    values = [mean(2), mean(3), mean(4), more * (mean(5) - mean(3) * mean(3)), more * (mean(6) - mean(4) * mean(4)), mean(7), more * (mean(8) - mean(4) * mean(3))]
    return rows.select("state", *[v.alias(n) for n, v in zip(NAMES, values)])
