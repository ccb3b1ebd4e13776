"""Writers: tables by object, corrected tracks, summaries, and updates by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_by_key(df: DataFrame, path: str, buckets: int = 64, key: str = "bid", mode: str = "overwrite") -> None:
    """Parquet in ``buckets`` folders by hash of the key, sorted by it: lookups of one object read one folder's few row groups."""
    part = F.pmod(F.xxhash64(key), F.lit(buckets))
    df.withColumn("bucket", part).repartition("bucket").sortWithinPartitions(key).write.mode(mode).partitionBy("bucket").parquet(path)


def read_by_key(spark, path: str, value, buckets: int = 64, key: str = "bid") -> DataFrame:
    """One object's rows; the folder is found from the key."""
    wanted = F.lit(value).cast("long")
    return spark.read.parquet(path).where((F.col("bucket") == F.pmod(F.xxhash64(wanted), F.lit(buckets))) & (F.col(key) == wanted)).drop("bucket")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def corrected_rows(observations: DataFrame, members: DataFrame, key: str = "bid", group: str = "node_id", frame: str = "frame", order: str = "bid") -> tuple[DataFrame, DataFrame]:
    """(first row of each group's frame, the rows beyond it): an object without group stands for itself."""
    rows = observations.join(members, key, "left").withColumn(group, F.coalesce(group, key))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, frame).orderBy(order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def lost_and_found(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, a, b: (0, node) at the birth of a node without predecessor; at a node's end (node, successor) each, else (node, 0)."""
    born = nodes.join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti").select(F.col("born_f").alias("frame"), F.lit(0).cast("long").alias("a"), F.col("node_id").alias("b"))
    died = nodes.join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id", "left").select(F.col("died_f").alias("frame"), F.col("node_id").alias("a"), F.coalesce("dst", F.lit(0).cast("long")).alias("b"))
    return born.unionAll(died)


def lost_and_found_known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``lost_and_found`` where nodes have n_in and n_out and edges src_died_f, the end of their source: the edges pass through, joined with nothing."""
    zero = F.lit(0).cast("long")
    born = nodes.where("n_in = 0").select(F.col("born_f").alias("frame"), zero.alias("a"), F.col("node_id").alias("b"))
    died = nodes.where("n_out = 0").select(F.col("died_f").alias("frame"), F.col("node_id").alias("a"), zero.alias("b"))
    return born.unionAll(died).unionAll(edges.select(F.col("src_died_f").alias("frame"), F.col("src").alias("a"), F.col("dst").alias("b")))


def summary_lines(events: DataFrame, heads: DataFrame, written: DataFrame) -> DataFrame:
    """frame, line: a frame's head columns and its pairs behind '%%'; ids that weren't written become 0, and '0 0' goes.

    heads (frame, head); written (node_id).
    """
    ids = written.select("node_id").distinct()
    known = events.join(ids.toDF("a"), "a", "left_semi").select("frame", "a", "b").unionAll(events.join(ids.toDF("a"), "a", "left_anti").select("frame", F.lit(0).cast("long").alias("a"), "b"))
    known = known.join(ids.withColumn("_known", F.lit(True)).toDF("b", "_known"), "b", "left").withColumn("b", F.when(F.col("_known"), F.col("b")).otherwise(0))
    pairs = known.where("a != 0 or b != 0").groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda p: F.concat_ws(" ", p.a, p.b)), " ").alias("pairs"))
    return heads.join(pairs, "frame", "left").select("frame", F.concat_ws(" %% ", "head", "pairs").alias("line"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys (of equal keys in ``changes`` the last by all columns)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in changes.columns])
    latest = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return table.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def split_parts(df: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """part (from 1): a key's rows in ``n`` parts of nearly equal size."""
    return df.withColumn("part", F.ntile(n).over(Window.partitionBy(key).orderBy(order)))
