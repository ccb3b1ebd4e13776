"""Readers and parsers of the tracker's text formats, and of its tables.

A summary has one line a frame: fixed columns, then ``%%`` and pairs
(predecessor, successor) of object ids, 0 for none, then ``%%%`` and pairs of
object id and place in the outline files. An outline file has a line ``% id``
before each object's lines ``frame time x y ... % spine %% x y n code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREP_TABLES = {
    "bounds": "bid long, x_min double, x_max double, y_min double, y_max double",
    "sizes": "bid long, area_median double, midline_median double",
    "terminals": "bid long, x0 double, y0 double, t0 double, f0 int, xN double, yN double, tN double, fN int",
    "roi": "bid long, inside_roi boolean",
    "moved": "bid long, bl_moved double",
    "matches": "frame int, bid long, good boolean, roi boolean, join string",
}


def read_prep_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.csv(path, schema=PREP_TABLES[kind], header=True)


def pair_list(text: Column) -> Column:
    """'a b c d' -> [(a, b), (c, d)]; an odd last value is left out."""
    a = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    k = F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1)
    pairs = F.transform(k, lambda i: F.struct(F.get(a, 2 * i).alias("a"), F.get(a, 2 * i + 1).alias("b")))
    return F.when(F.size(a) >= 2, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def summary_frames(lines: DataFrame, text: str = "value") -> DataFrame:
    """frame, time, links (pairs of ids), places (id, file.offset) of each line."""
    head = F.split(F.trim(F.split(text, "%").getItem(0)), r"\s+")
    events = F.regexp_extract(text, r"(?:^|[^%])%%([^%]*)", 1)
    places = F.regexp_extract(text, r"%%%([^%]*)", 1)
    ids = lambda pairs: F.transform(pairs, lambda p: F.struct(p.a.try_cast("long").alias("a"), p.b.try_cast("long").alias("b")))
    return lines.select(head[0].try_cast("long").alias("frame"), head[1].try_cast("double").alias("time"), ids(pair_list(events)).alias("links"), pair_list(places).alias("places")).where("frame is not null")


def births_and_deaths(frames: DataFrame) -> DataFrame:
    """bid, born_f, born_t, died_f, died_t: links (0 or predecessor, successor or 0); objects without an end live to the last line."""
    links = frames.select("frame", "time", F.explode("links").alias("l"))
    born = links.where("l.b != 0").groupBy(F.col("l.b").alias("bid")).agg(F.min(F.struct("frame", "time")).alias("born"))
    died = links.where("l.a != 0").groupBy(F.col("l.a").alias("bid")).agg(F.max(F.struct("frame", "time")).alias("died"))
    last = frames.agg(F.max(F.struct("frame", "time")).alias("last"))  # one row
    out = born.join(died, "bid", "full").crossJoin(F.broadcast(last)).withColumn("died", F.coalesce("died", "last"))
    return out.select("bid", F.col("born.frame").alias("born_f"), F.col("born.time").alias("born_t"), F.col("died.frame").alias("died_f"), F.col("died.time").alias("died_t"))


def with_header(lines: DataFrame, file: str, number: str, text: str = "value") -> DataFrame:
    """The lines that aren't headers, with bid from the last header ``% id`` above them in their file."""
    header = F.regexp_extract(text, r"^%\s*(\d+)\s*$", 1)
    bid = F.last(F.nullif(header, F.lit("")), True).over(Window.partitionBy(file).orderBy(number))
    return lines.withColumn("bid", bid.cast("long")).where((header == "") & F.col("bid").isNotNull())


def outline_fields(text: Column) -> Column:
    """struct<x, y, n, code> from behind '%%'; null unless it has all four."""
    parts = F.split(F.trim(F.get(F.split(text, "%%"), F.lit(1))), r"\s+")
    return F.when(F.size(parts) == 4, F.struct(parts[0].try_cast("int").alias("x"), parts[1].try_cast("int").alias("y"), parts[2].try_cast("int").alias("n"), parts[3].alias("code")))
