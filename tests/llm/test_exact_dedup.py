"""Exact dedup against a dictionary of texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string"


def expected(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        some = [i for i in ids if i is not None]
        keep = (max if largest else min)(some) if some else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(df, rows, largest):
    got = exact_dedup(df, keep="largest" if largest else "smallest").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows, largest)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("largest", [True, False])
def test_hot_groups_nulls_ties_and_long_texts(spark, largest):
    rng = random.Random(1)
    rows = [(i, "the same text everywhere") for i in range(0, 3000, 3)]
    rows += [(i, rng.choice(["", None, " ", "a", "A", "é", "é", "the same text", "the same text everywhere "])) for i in range(1, 600, 3)]
    rows += [(i, f"only here {i}") for i in range(2, 2000, 3)] + [(None, "a"), (None, "null only"), (None, "null only"), (7, "a"), (7, "a"), (-5, "long " * 60_000), (5000, "long " * 60_000)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA).repartition(9), rows, largest)


def test_every_partition_full_of_one_text(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(i, "hot") for i in range(900)] + [(i, f"hot{i % 7}") for i in range(900, 1000)]
        check(spark.createDataFrame(rows, SCHEMA).repartition(8), rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_empty_tables_other_columns_and_normal_forms(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("b", " X", 1, 2), ("a", "x ", 3, 4), ("c", "y", 5, 6)], "doc_id string, text string, hash int, ids int")
    got = exact_dedup(df, normalise=lambda c: F.lower(F.trim(c))).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]
