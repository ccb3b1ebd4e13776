"""Principal components as read-outs: scores, reconstructions and their distances, by array expressions.

``components``: a list of k loading vectors of d numbers; ``means`` and
``spreads``: d numbers each. They are parameters of fixed size, and go into the
plan as literals. A row's array of another length gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def standardise(obs: Column, means, spreads) -> Column:
    return F.zip_with(F.zip_with(obs.cast("array<double>"), vector(means), lambda x, m: x - m), vector(spreads), lambda x, s: x / s)


def unstandardise(variables: Column, means, spreads) -> Column:
    return F.zip_with(F.zip_with(variables, vector(spreads), lambda x, s: x * s), vector(means), lambda x, m: x + m)


def vars_pc(variables: Column, components) -> Column:
    """Scores of standardised variables: one dot product a component."""
    known = F.size(variables) == len(components[0])
    return F.when(known, F.array(*[dot(variables, vector(c)) for c in components]))


def pc_vars(scores: Column, components) -> Column:
    """The variables that scores stand for."""
    d = len(components[0])
    return F.array(*[sum((F.get(scores, F.lit(k)) * float(c[i]) for k, c in enumerate(components)), F.lit(0.0)) for i in range(d)])


def obs_pc(obs: Column, means, spreads, components) -> Column:
    return vars_pc(standardise(obs, means, spreads), components)


def pc_obs(scores: Column, means, spreads, components) -> Column:
    return unstandardise(pc_vars(scores, components), means, spreads)


def reconstructions(df: DataFrame, obs: str, means, spreads, components, only: int | None = None) -> DataFrame:
    """scores and approximation of each row; ``only``: of that component alone."""
    chosen = components if only is None else [components[only]]
    df = df.withColumn("scores", obs_pc(F.col(obs), means, spreads, chosen))
    return df.withColumn("approximation", pc_obs(F.col("scores"), means, spreads, chosen))


def distances(a: Column, b: Column) -> tuple[Column, Column]:
    """(euclidean distance, cosine distance)"""
    difference = F.zip_with(a, b, lambda x, y: x - y)
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.sqrt(dot(difference, difference)), 1 - cosine


def transposed(df: DataFrame, row: str, values: str) -> DataFrame:
    """column (from 0), row, value of a matrix given by rows, long."""
    return df.select(F.col(row).alias("row"), F.posexplode(values).alias("column", "value")).select("column", "row", "value")


def component_lines(df: DataFrame, row: str, scores: str) -> DataFrame:
    """row, line: the id and its scores with six decimals, for a text writer."""
    return df.select(row, F.concat_ws(" ", F.col(row).cast("string"), F.array_join(F.transform(scores, lambda v: F.format_string("%.6f", v)), " ")).alias("line"))


def cluster_loadings(df: DataFrame, cluster: str, scores: str) -> DataFrame:
    """cluster, component, mean, spread, n of the scores of its rows."""
    long = df.select(cluster, F.posexplode(scores).alias("component", "score"))
    return long.groupBy(cluster, "component").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.count("*").alias("n"))
