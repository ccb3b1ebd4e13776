"""Streaming forms of the track operators: sessions, bins, and gap stitching with state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events of a folder as a stream with an event time."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def bins(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n, value: tumbling windows; rows later than ``late`` behind the newest are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "4 hours") -> DataFrame:
    """user_id, start, end, n: each user's events without a pause of ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def _stitch(limit: float):
    def one(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last, number) = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["seconds", "event_id"])
        out = []
        for t, e in zip(rows["seconds"].tolist(), rows["event_id"].tolist()):
            if last is not None and t - last >= limit:
                number += 1
            last = t if last is None else max(last, t)
            out.append((key[0], e, number))
        state.update((last, number))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "track"])

    return one


def stitch(events: DataFrame, limit_seconds: float = 14400) -> DataFrame:
    """user_id, event_id, track: the number of the user's track, kept in state from batch to batch."""
    rows = events.select("user_id", "event_id", F.unix_micros("ts").cast("double").alias("us")).withColumn("seconds", F.col("us") / 1e6).drop("us")
    return rows.groupBy("user_id").applyInPandasWithState(_stitch(limit_seconds), "user_id long, event_id long, track long", "last double, number long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Writes all that is there now as Parquet below ``folder``, with a checkpoint beside it, and reads it.

    In complete mode each batch replaces what the one before wrote.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
