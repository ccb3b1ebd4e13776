"""Queries of the states of motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import state_fits, states
from trackloom.plans.registry import query
from trackloom.sources.tracks import T_SQL, observations, table

STATES = [
    {"reversal": 0.1, "speed": 0.3, "along": 0.2, "var_speed": 0.05, "var_along": 0.04, "var_radial": 0.1, "cov": 0.01},
    {"reversal": 0.6, "speed": 0.8, "along": 0.7, "var_speed": 0.08, "var_along": 0.06, "var_radial": 0.2, "cov": -0.02},
]


def likelihood(p: dict) -> str:
    plane = p["var_speed"] * p["var_along"] - p["cov"] ** 2
    s, a = f"(s - {p['speed']})", f"(a - {p['along']})"
    square = f"(({p['var_along']} * {s} * {s} - 2 * ({p['cov']}) * {s} * {a} + {p['var_speed']} * {a} * {a}) / {plane!r} + ar * ar / {p['var_radial']})"
    return f"(CASE WHEN r THEN {p['reversal']} ELSE {1 - p['reversal']} END * 4 / (pi() ** 2 * sqrt({plane * p['var_radial']!r})) / (1 + {square}) ** 3)"


P_SQL = f"""{T_SQL}, o AS (SELECT bid, frame, kind = 'view' AS r, x / 100 AS s, y / 100 AS a, (area - 50) / 100 AS ar FROM t),
l AS (SELECT *, {likelihood(STATES[0])} AS l0, {likelihood(STATES[1])} AS l1 FROM o), p AS (SELECT *, l0 / (l0 + l1) AS p0, l1 / (l0 + l1) AS p1 FROM l)"""


def motion(spark, sf_dir):
    rows = observations(spark, sf_dir).select("bid", "frame", (F.col("kind") == "view").alias("r"), (F.col("x") / 100).alias("s"), (F.col("y") / 100).alias("a"), ((F.col("area") - 50) / 100).alias("ar"))
    return states.state_probabilities(rows, STATES, "r", "s", "a", "ar")


@query(f"WITH {P_SQL} SELECT bid, frame, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1 FROM p")
def state_probabilities(spark, sf_dir):
    return motion(spark, sf_dir).select("bid", "frame", *[(F.round(c, 6) + 0.0).alias(c) for c in ("p0", "p1")])


def estimates(k: int) -> str:
    m = {n: f"sum(p{k} * {e}) / sum(p{k})" for n, e in (("r", "CAST(r AS DOUBLE)"), ("s", "s"), ("a", "a"), ("ss", "s * s"), ("aa", "a * a"), ("rr", "ar * ar"), ("sa", "s * a"))}
    c = f"(1 / (1 - sum(p{k} * p{k}) / sum(p{k}) ** 2))"
    v = [m["r"], m["s"], m["a"], f"{c} * ({m['ss']} - ({m['s']}) ** 2)", f"{c} * ({m['aa']} - ({m['a']}) ** 2)", m["rr"], f"{c} * ({m['sa']} - ({m['a']}) * ({m['s']}))"]
    return f"SELECT {k} AS state, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for e, n in zip(v, states.NAMES)) + " FROM p"


@query(f"WITH {P_SQL} {estimates(0)} UNION ALL {estimates(1)}")
def estimated_states(spark, sf_dir):
    return states.estimated_states(motion(spark, sf_dir), 2, "r", "s", "a", "ar").select("state", *[(F.round(c, 6) + 0.0).alias(c) for c in states.NAMES])


@query()
def fitted_states(spark, sf_dir):
    """One, two and three states fitted to each object's rows."""
    out = state_fits.fitted_states(motion(spark, sf_dir), ("r", "s", "a", "ar"), tau=10.0, step=1.0)
    numbers = [*states.NAMES, "weight", "entropy"]
    return out.select("bid", "states", "state", *[(F.round(c, 5) + 0.0).alias(c) for c in numbers], F.transform("moves", lambda m: F.round(m, 5)).alias("moves"), "rounds")


@query("SELECT r_regionkey, i, j, round((1 - f) / m + CASE WHEN i = j THEN f ELSE 0 END, 6) + 0.0 AS p FROM (SELECT r_regionkey, r_regionkey + 2 AS m, exp(-0.1 * (r_regionkey + 2) / ((r_regionkey + 1) * 10.0)) AS f FROM region), (SELECT unnest(range(0, 2)) AS i), (SELECT unnest(range(0, 2)) AS j)")
def transition_start(spark, sf_dir):
    """The first two states of the matrices for two to six states."""
    rows = [(m - 2, i, j, states.transition_matrix(10, 0.1, m)[i][j]) for m in range(2, 7) for i in range(2) for j in range(2)]
    found = spark.createDataFrame(rows, "r_regionkey int, i long, j long, p double")
    return table(spark, sf_dir, "region").select("r_regionkey").join(found, "r_regionkey").select("r_regionkey", "i", "j", (F.round("p", 6) + 0.0).alias("p"))
