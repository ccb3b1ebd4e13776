"""Queries and updates on tables of entries: selection, consistency, defaults and relabelling.

Conditions are columns of the table's own fields. A condition that is null for
a row doesn't hold for it. Nothing is changed in place: an update is a new table
for a writer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find(df: DataFrame, condition: Column | None = None, fields: list[str] | None = None, one_by: str | None = None) -> DataFrame:
    """Matching rows and the wanted fields; with ``one_by`` only the row with its smallest value."""
    found = df if condition is None else df.where(condition)
    found = found if one_by is None else found.orderBy(one_by).limit(1)
    return found.select(*fields) if fields else found


def any_of(field: str, values: list, also: Column | None = None) -> Column:
    """The condition that a field has one of the values."""
    one = F.col(field).isin(values)
    return one if also is None else one & also


def distinct_values(df: DataFrame, key: str, field: str, condition: Column | None = None) -> DataFrame:
    """key, values: the distinct values that its rows have, sorted; as many as the field has kinds."""
    found = df if condition is None else df.where(condition)
    return found.groupBy(key).agg(F.array_sort(F.collect_set(field)).alias("values"))


def delete_where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """The rows that none of the conditions holds for."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
    return df.where(~hit)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column], only_first_by: str | None = None) -> DataFrame:
    """New values where the condition holds; with ``only_first_by`` in one row of these alone, that with its smallest value (unique)."""
    hit = F.coalesce(condition, F.lit(False))
    if only_first_by:
        least = df.where(hit).agg(F.min(only_first_by).alias("_least"))
        df = df.join(F.broadcast(least)).withColumn("_hit", hit & (F.col(only_first_by) == F.col("_least"))).drop("_least")  # one row
    else:
        df = df.withColumn("_hit", hit)
    return df.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) if c in df.columns else F.when(F.col("_hit"), v) for c, v in values.items()}).drop("_hit")


def rename_everywhere(tables: dict[str, DataFrame], names: dict[str, str]) -> dict[str, DataFrame]:
    return {t: df.withColumnsRenamed(names) for t, df in tables.items()}


def delete_untyped(df: DataFrame, field: str, kind: str) -> DataFrame:
    """Without the rows whose field isn't null and can't be read as ``kind``."""
    return df.where(F.col(field).isNull() | F.col(field).try_cast(kind).isNotNull())


def combine_parts(df: DataFrame, key: str, part: str, attributes: list[str], values: str) -> DataFrame:
    """key, attributes, consistent (all parts agree on each), parts, n: the entries that belong together; of attributes that differ the smallest."""
    agree = reduce(lambda a, b: a & b, [F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1)))) for c in attributes])
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in attributes], agree.alias("consistent"), F.count_distinct(part).alias("parts"), F.count(values).alias("n"))


def merge_maps(a: Column, b: Column) -> Column:
    """Maps of arrays: keys of both, values united in order; null is empty."""
    return F.map_zip_with(a, b, lambda _, x, y: F.array_distinct(F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array()))))


def add_attribute(nodes: DataFrame, values: DataFrame, key: str, name: str, default=None) -> tuple[DataFrame, DataFrame]:
    """(nodes with the attribute, the default where ``values`` (key, value) has none; one row found, missed)."""
    joined = nodes.join(values.select(key, F.col("value").alias("_value"), F.lit(True).alias("_found")), key, "left")
    counts = joined.agg(F.count_if("_found").alias("found"), F.count_if(F.col("_found").isNull()).alias("missed"))
    return joined.withColumn(name, F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")).drop("_value", "_found"), counts


def metadata_rows(recordings: DataFrame, objects: DataFrame, key: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """A row for each object with its own attributes and its recording's."""
    return objects.join(recordings.select(*[c for c in recordings.columns if c == key or (c not in objects.columns and c not in skip)]), key, "left")


def with_defaults(wanted: DataFrame, found: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """A row for each wanted key; defaults where there was none, or null."""
    out = wanted.select(*keys).distinct().join(found, keys, "left")
    return out.na.fill({c: v for c, v in defaults.items() if v is not None})


def choose(objects: DataFrame, key: str, condition: Column, having: list[DataFrame], lacking: list[DataFrame]) -> DataFrame:
    """Keys of matching rows that all of ``having`` have and none of ``lacking``."""
    out = objects.where(condition).select(key).distinct()
    out = reduce(lambda d, other: d.join(other.select(key), key, "left_semi"), having, out)
    return reduce(lambda d, other: d.join(other.select(key), key, "left_anti"), lacking, out)


def wide_matrix(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One row a ``row``, a column for each of ``columns``: the value of the pair with the smallest one."""
    return df.groupBy(row).pivot(column, columns).agg(F.min(value))


def pair_attributes(pairs: DataFrame, left: str, right: str, attributes: DataFrame, key: str) -> DataFrame:
    """``pairs`` with the attributes of both ends, suffixed _1 and _2."""
    for end, suffix in ((left, "_1"), (right, "_2")):
        renamed = attributes.withColumnsRenamed({c: f"{c}{suffix}" for c in attributes.columns if c != key}).withColumnRenamed(key, end)
        pairs = pairs.join(renamed, end, "left")
    return pairs


def merge_on_ticks(tables: list[DataFrame], step: float, key: str = "bid", time: str = "time") -> DataFrame:
    """Tables of one key joined where their times are the same multiple of ``step``; of several rows a tick the earliest counts."""
    ticked = []
    for df in tables:
        w = Window.partitionBy(key, "tick").orderBy(time)
        rows = df.withColumn("tick", F.round(F.col(time) / step).cast("long")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        ticked.append(rows if not ticked else rows.drop(time))
    return reduce(lambda a, b: a.join(b, [key, "tick"]), ticked)


def padded_number(column: Column, digits: int = 5) -> Column:
    """With zeros in front; longer numbers stay whole."""
    text = column.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def percentage(part: Column, whole: Column) -> Column:
    """0 where there is nothing."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def fields_of_parts(df: DataFrame, key: str, entries: str) -> DataFrame:
    """key, time, value: the maps time -> value of an object's parts as rows; of equal times the greatest value."""
    return df.select(key, F.explode(entries).alias("time", "value")).groupBy(key, "time").agg(F.max("value").alias("value"))
