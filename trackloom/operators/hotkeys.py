"""Joins whose keys may be very frequent on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def attach(rows: DataFrame, values: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``values``, which has at most one row a key.

    A key's rows are dealt over ``salts`` tasks by a hash of ``spread_by``; only
    the (key, salt) pairs that occur are joined with ``values``, so no task gets
    all rows of a frequent key. Null keys find nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    spread = salted.select(*on, "_salt").distinct().join(values, on)
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
