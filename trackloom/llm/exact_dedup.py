"""Exact dedup by a content sort.

Equal texts of a batch travel as one row with their ids. Sampled splitters
range-partition the rows by (first bytes, hash, ids), so that equal texts meet in
one partition, or in neighbouring ones where they are too many for one. Each
partition is sorted externally by the whole bytes; neighbours are compared in
full, and a run of equals names the row that stays. Only the first and the last
run of a partition can go on elsewhere: they are compared with each other as a
small table, with their whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from trackloom.llm.textbytes import give_back
from trackloom.plans.lineage import stored

HEAD_BYTES = 16


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ids): each text of a batch once, with the ids that it has there."""
    for batch in batches:
        texts = batch.column("text").dictionary_encode()
        codes = texts.indices.to_numpy()
        offsets = np.zeros(len(texts.dictionary) + 1, dtype=np.int32)
        np.cumsum(np.bincount(codes, minlength=len(texts.dictionary)), out=offsets[1:])
        ids = batch.column("id").take(pa.array(np.argsort(codes, kind="stable")))
        yield pa.RecordBatch.from_arrays([texts.dictionary, pa.ListArray.from_arrays(pa.array(offsets), ids)], ["text", "ids"])
    give_back()


def _keeper(ids: list, largest: bool):
    some = [i for i in ids if i is not None]
    return (max(some) if largest else min(some)) if some else None


def _runs(largest: bool, id_type: pa.DataType) -> Callable:
    """Rows (text, hash, ids), sorted by hash and text within what is equal in ``head``, as a row for each id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_runs = TaskContext.get().partitionId(), 0
        text, run_hash, ids = None, None, []  # of the run that goes on
        first_hash, waiting = None, []  # finished runs with the hash of the run that goes on
        out: list[tuple] = []

        def finish() -> None:
            nonlocal n_runs
            keep = _keeper(ids, largest)
            waiting.append((n_runs, text, list(ids), keep, hashlib.sha256(text).hexdigest()))
            n_runs += 1

        def release(at_end: bool) -> None:
            edge = at_end or run_hash == first_hash
            for number, whole, members, keep, digest in waiting:
                winner = members.index(keep)
                out.extend((i, part, number, keep, len(members), digest, k == winner, edge, whole if edge and k == winner else None) for k, i in enumerate(members))
            waiting.clear()

        def take() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = [id_type, pa.int64(), pa.int64(), id_type, pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "part", "run", "keep", "size", "digest", "winner", "edge", "whole"])

        for batch in batches:
            texts, hashes, lists = batch.column("text"), batch.column("hash").to_pylist(), batch.column("ids").to_pylist()
            same = np.zeros(len(hashes), dtype=bool)
            same[1:] = pc.equal(texts.slice(1), texts.slice(0, len(hashes) - 1)).to_numpy(zero_copy_only=False)
            for k, (h, members) in enumerate(zip(hashes, lists)):
                if not (same[k] if k else text is not None and texts[0].as_py() == text):
                    if text is not None:
                        finish()
                    if h != run_hash:
                        release(False)
                        first_hash = h if text is None else first_hash
                    text, run_hash, ids = texts[k].as_py(), h, []
                ids.extend(members)
                if len(out) >= 20_000:
                    yield take()
        if text is not None:
            finish()
            release(True)
        if out:
            yield take()
        give_back()

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "smallest") -> DataFrame:
    """One row for each row of ``docs``: the id column, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after ``normalise`` (of a column of
    strings; None: no change). Of equal texts the row with the smallest id stays,
    or the largest (``keep``). text_sha256: of the normalised text in UTF-8.

    A null text is empty, and all empty texts are equal; a null id never stays
    beside others; of repeated rows (one id, equal texts) one stays, and all count
    in group_size; an empty table gives an empty result; extra columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    largest = keep == "largest"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (normalise(text) if normalise else text).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType
    gathered = rows.mapInArrow(_gather, f"text binary, ids array<{id_type.simpleString()}>")
    keyed = gathered.select(F.substring("text", 1, HEAD_BYTES).alias("head"), F.xxhash64("text").alias("hash"), F.xxhash64("ids").alias("tie"), "text", "ids")
    content = keyed.repartitionByRange("head", "hash", "tie").sortWithinPartitions("head", "hash", "text").select("text", "hash", "ids")

    schema = StructType().add("id", id_type).add("part", LongType()).add("run", LongType()).add("keep", id_type).add("size", LongType())
    schema = schema.add("digest", "string").add("winner", "boolean").add("edge", "boolean").add("whole", "binary")
    arrow_id = pa.string() if id_type.typeName() == "string" else pa.from_numpy_dtype({"long": "i8", "integer": "i4", "short": "i2", "byte": "i1"}[id_type.typeName()])
    found = stored(content.mapInArrow(_runs(largest, arrow_id), schema), "runs")

    ends = found.where("whole is not null").select("part", "run", "keep", "size", "whole")
    best = F.max(F.struct("keep", "part", "run")) if largest else F.min(F.struct(F.isnull("keep"), "keep", "part", "run"))
    joined = ends.groupBy("whole").agg(best.alias("best"), F.sum("size").alias("all"))
    ends = ends.select("part", "run", "whole").join(joined, "whole").select("part", "run", "best", "all")
    inner = found.where("not edge").select("id", "keep", "size", "winner", "digest")
    at_edges = found.where("edge").select("id", "part", "run", "winner", "digest").join(ends, ["part", "run"])
    stays = F.col("winner") & (F.col("best.part") == F.col("part")) & (F.col("best.run") == F.col("run"))
    at_edges = at_edges.select("id", F.col("best.keep").alias("keep"), F.col("all").alias("size"), stays.alias("winner"), "digest")
    out = inner.unionByName(at_edges)
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("winner").alias("kept"), F.col("digest").alias("text_sha256"))
