"""Cutting the lineage of iterative jobs with files that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark takes it to have, so that Python code on any machine means the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return f"file://{found[5:]}" if found.startswith("file:/") and not found.startswith("file://") else found


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder: later jobs read it and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def large(df: DataFrame) -> DataFrame:
    """``df``, whose size, and that of all that is made of it, no plan takes for small before it is known.

    The planner takes a table for as large as its compressed files, and an explode
    for as large as its input, so that it would gather millions of rows on the
    driver to broadcast them. A product with one row counts as large; joins are
    still turned into broadcasts where a running query finds few bytes.
    """
    one = df.sparkSession.range(4096).where("id = 0").select(F.col("id").alias("_one"))
    return df.crossJoin(F.broadcast(one)).drop("_one")


#: The folders of the innermost ``scratch`` block of this thread, if there is one.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: later jobs read the columns they need.

    A table stays until the ``scratch`` block that it was made in ends, or else
    until the shared folder is cleared: a result may be read long after the call.
    """
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this block has stored at its end; what was made of them has to be written by then.

    A block owns only what is stored inside it, in its own thread: tables of other
    threads, of blocks around it and of callers without a block stay.
    """
    owned: list[str] = []
    before = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(before)
        for folder in owned:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
