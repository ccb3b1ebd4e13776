"""What a point sees within reach of it on a line, without a row for each pair: counts, sums and extremes, few links with the same components, all that can be reached, and what a few steps lead to."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.batches import arrow_schema, dealt
from trackloom.plans.lineage import cut

#: A group is a stretch of a key's line this many reaches long, and the reach beyond it.
STRETCH = 4


def _stretches(rows: DataFrame, reach: float, twice: bool) -> DataFrame:
    """``rows`` (key, at) by _part; with ``twice``, rows within ``reach`` of a part's beginning are in the part before, too."""
    size = STRETCH * reach
    here = F.floor(F.col("at") / size)
    parts = F.sequence(F.floor((F.col("at") - reach * (1 + 1e-6)) / size), here) if twice else F.array(here)
    return rows.where("key IS NOT NULL AND at IS NOT NULL").withColumn("_part", F.explode(parts))


def in_reach(seekers: DataFrame, sought: DataFrame, reach: float, columns: list[str] = []) -> DataFrame:  # noqa: B006
    """id, n, and sum, least and most of each of ``columns``, of the sought after each seeker by up to ``reach``.

    seekers: id, key, at; sought: key, at, ``columns`` (without nulls). A seeker
    sees the rows of its key with 0 < sought.at - seeker.at <= reach; one that
    sees none has no row. Rows are sorted by stretches of the line, and counts and
    sums are differences of running sums: nothing grows with the pairs that meet
    but the work of the extremes.
    """
    kinds = {c: sought.schema[c].dataType.simpleString() for c in columns}
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    named = [(c, f) for c in columns for f in ("sum", "least", "most")]
    schema = f"id {kind(seekers, 'id')}, n long" + "".join(f", {c}_{f} {kinds[c]}" for c, f in named)

    def seen(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at")
        at, line = a["at"].to_numpy(), b["at"].to_numpy()
        top = at + reach
        top = np.where(top - at > reach, np.nextafter(top, -np.inf), top)  # the largest number whose difference is no more than reach
        low, high = np.searchsorted(line, at, "right"), np.searchsorted(line, top, "right")
        some = high > low
        low, high = low[some], high[some]
        out = {"id": a["id"].to_numpy()[some], "n": high - low}
        bounds = np.column_stack([low, high]).ravel()
        for c in columns:
            v = b[c].to_numpy()
            total = np.concatenate([v[:0], np.zeros(1, v.dtype), np.cumsum(v)])
            padded = np.append(v, v[-1:])  # a window may end where the line does
            out[f"{c}_sum"] = total[high] - total[low]
            out[f"{c}_least"] = np.minimum.reduceat(padded, bounds)[::2] if len(low) else v[:0]
            out[f"{c}_most"] = np.maximum.reduceat(padded, bounds)[::2] if len(low) else v[:0]
        return pd.DataFrame(out)

    a = _stretches(seekers.select("id", "key", "at"), reach, False).groupBy("key", "_part")
    return a.cogroup(_stretches(sought.select("key", "at", *columns), reach, True).groupBy("key", "_part")).applyInPandas(seen, schema)


def few_links(seekers: DataFrame, sought: DataFrame, reach: float) -> DataFrame:
    """src, dst: links with the same connected components as all pairs (seeker, sought) that ``in_reach`` would count, at most two a row and part.

    seekers and sought: id, key, at. A sought row is linked with the last seeker
    before it. Neighbouring seekers that both see some row both see the first one
    after the later of them; they are linked with each other.
    """
    kind = seekers.schema["id"].dataType.simpleString()

    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("at"), b.sort_values("at")
        ends, starts, i, j = a["at"].to_numpy(), b["at"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()
        before = np.searchsorted(ends, starts, "left") - 1
        own = before >= 0
        own[own] = starts[own] - ends[before[own]] <= reach
        after = np.searchsorted(starts, ends[1:], "right")  # the first row that the later of two seekers sees
        both = after < len(starts)
        both[both] = starts[after[both]] - ends[:-1][both] <= reach
        return pd.DataFrame({"src": np.concatenate([i[before[own]], i[:-1][both]]), "dst": np.concatenate([j[own], i[1:][both]])})

    rows = lambda df: _stretches(df.select("id", "key", "at"), reach, True).groupBy("key", "_part")
    return rows(seekers).cogroup(rows(sought)).applyInPandas(links, f"src {kind}, dst {kind}").distinct()


class _Window:
    """The union of the sets (bits of a number) that came on within ``reach``; a queue as two stacks, so that each is united twice at most."""

    def __init__(self, reach: float):
        self.reach, self.front, self.back, self.union = reach, [], [], 0

    def push(self, at: float, bits: int) -> None:
        self.back.append((at, bits))
        self.union |= bits

    def at(self, now: float) -> int:
        while self.front or self.back:
            if not self.front:
                united = 0
                for at, bits in reversed(self.back):
                    united |= bits
                    self.front.append((at, united))
                self.back, self.union = [], 0
            if now - self.front[-1][0] <= self.reach:
                break
            self.front.pop()
        return (self.front[-1][1] if self.front else 0) | self.union


#: Starts that walk along the line together.
TOGETHER = 256


def reachable(nodes: DataFrame, reach: float) -> DataFrame:
    """start, id: each start and all that can be reached from it, over any number of steps.

    nodes: id, key, at (where it is entered), key2, at2 (where it is left, not
    before ``at``), start (is it one?). A step leads to the nodes with 0 < at -
    at2 <= reach on the line of key2. About ``TOGETHER`` starts are a group: a task goes once
    along the line for it, and keeps the nodes that are entered and not yet left
    and those left within reach, each with the set of the starts that reach it.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    schema = arrow_schema(f"start {kind}, id {kind}")
    groups = math.ceil(nodes.where("start").count() / TOGETHER)
    own = F.when(F.col("start"), F.pmod(F.xxhash64("id"), F.lit(max(groups, 1))))
    rows = nodes.select("id", "key", "at", "key2", "at2", own.alias("_own")).crossJoin(F.broadcast(nodes.sparkSession.range(groups).toDF("_group")))
    rows = rows.select("_group", "at", "key", "at2", "key2", "id", (F.col("_own") == F.col("_group")).alias("own"))

    def spread(starts: list, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(found), 2000):
            part = found[k : k + 2000]
            width = (len(starts) + 7) // 8
            bits = np.frombuffer(b"".join(b.to_bytes(width, "little") for _, b in part), np.uint8).reshape(len(part), width)
            of, by = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
            ids = pa.array([i for i, _ in part], schema.field("id").type)
            yield pa.RecordBatch.from_arrays([pa.array(starts, ids.type).take(pa.array(by)), ids.take(pa.array(of))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, starts, inside, seen = None, [], [], {}
        for batch in batches:
            found = []
            for g, at, key, at2, key2, id_, own_ in zip(*[batch.column(c).to_pylist() for c in range(7)]):
                if g != group:
                    yield from spread(starts, found)
                    group, starts, inside, seen, found = g, [], [], {}, []
                while inside and inside[0][0] < at:  # left by now
                    left, _, by, bits = heapq.heappop(inside)
                    seen.setdefault(by, _Window(reach)).push(left, bits)
                bits = seen[key].at(at) if key in seen else 0
                if own_:
                    bits |= 1 << len(starts)
                    starts.append(id_)
                if bits:
                    found.append((id_, bits))
                    if key2 is not None:
                        heapq.heappush(inside, (at2, id_, key2, bits))
            yield from spread(starts, found)

    return dealt(rows, ["_group"]).sortWithinPartitions("_group", "at", "id").mapInArrow(run, f"start {kind}, id {kind}")


def _covering(at: np.ndarray, line: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ``at`` and sorted ``line``: for each place of the line, the range of those that are before it by up to ``reach``."""
    top = at + reach
    top = np.where(top - at > reach, np.nextafter(top, -np.inf), top)
    low, high = np.searchsorted(line, at, "right"), np.searchsorted(line, top, "right")
    place = np.arange(len(line))
    return np.searchsorted(high, place, "right"), np.searchsorted(low, place, "right")


def _united(bits: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The union of ``bits[first:last]`` for each (first, last), from the unions of 1, 2, 4, ... neighbours."""
    n, out = last - first, np.zeros(len(first), bits.dtype)
    size, spans = 1, bits
    while size <= n.max(initial=0):
        own = (n >= size) & (n < 2 * size)
        out[own] = spans[first[own]] | spans[last[own] - size]
        spans = spans[:-size] | spans[size:]
        size *= 2
    return out


#: Starts of a group: the bits of a long.
BITS = 64


def within_steps(nodes: DataFrame, reach: float, steps: int) -> DataFrame:
    """start, id, distance: each start and all that at most ``steps`` steps lead to, forth or back, with the least number of steps.

    nodes: id, key, at (where it is entered), key2, at2 (where it is left), start
    (is it one?). A step joins two nodes with 0 < at - at2 <= reach, the at2 on the
    line key2 of one and the at on the line key of the other. ``BITS`` starts near
    each other are a group, and a row is a node with the set of a group's starts
    that lead to it: neither pairs of neighbours nor those of start and node are stored.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    nodes = cut(nodes.select("id", "key", "at", "key2", "at2", "start"))
    number = F.row_number().over(Window.partitionBy("_block").orderBy("key2", "id")) - 1
    starts = nodes.where("start").withColumn("_block", F.coalesce(F.floor(F.col("at") / reach), F.lit(0))).withColumn("_n", number)
    starts = cut(starts.withColumns({"grp": F.col("_block") * (1 << 24) + F.floor(F.col("_n") / BITS), "bit": F.col("_n") % BITS}).drop("_block", "_n", "start"))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["grp", "at"]), b.sort_values("at")
        groups, at, bits, line = a["grp"].to_numpy(), a["at"].to_numpy(), a["bits"].to_numpy(), b["at"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(groups)) + 1, len(groups))
        places, of, found = [], [], []
        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()) if len(groups) and len(line) else ():
            union = _united(bits[i:j], *_covering(at[i:j], line, reach))
            hit = np.flatnonzero(union)
            places.append(hit)
            of.append(np.full(len(hit), groups[i]))
            found.append(union[hit])
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"id": b["id"].to_numpy()[whole(places)], "grp": whole(of), "bits": whole(found)})

    def step(front: DataFrame, down: bool) -> DataFrame:
        sign, mine, other = (1, "2", "") if down else (-1, "", "2")
        a = _stretches(front.select(F.col(f"key{mine}").alias("key"), (sign * F.col(f"at{mine}")).alias("at"), "grp", "bits"), reach, False)
        b = _stretches(nodes.select("id", F.col(f"key{other}").alias("key"), (sign * F.col(f"at{other}")).alias("at")), reach, True)
        b = b.join(a.select("key", "_part").distinct(), ["key", "_part"], "left_semi")
        return a.groupBy("key", "_part").cogroup(b.groupBy("key", "_part")).applyInPandas(met, f"id {kind}, grp long, bits long")

    front = starts.withColumn("bits", F.expr("shiftleft(1L, CAST(bit AS INT))"))
    levels = [front.select("id", "grp", "bits")]
    for k in range(1, steps + 1):
        found = step(front, True).union(step(front, False))
        if k < steps:
            found = cut(found.repartition("id").groupBy("id", "grp").agg(F.bit_or("bits").alias("bits")))
            front = found.join(nodes.drop("start"), "id")
        levels.append(found)
    rows = levels[0].withColumn("_k", F.lit(0))
    for k, found in enumerate(levels[1:], 1):
        rows = rows.union(found.withColumn("_k", F.lit(k)))
    sets = rows.repartition("grp").groupBy("grp", "id").agg(*[F.coalesce(F.bit_or(F.when(F.col("_k") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"_{k}") for k in range(steps + 1)])
    before, new = F.lit(0).cast("long"), []
    for k in range(steps + 1):
        new.append(F.struct(F.lit(k).alias("distance"), F.col(f"_{k}").bitwiseAND(F.bitwise_not(before)).alias("bits")))
        before = before.bitwiseOR(F.col(f"_{k}"))
    members = starts.groupBy("grp").agg(F.collect_list(F.struct(F.col("bit").cast("int").alias("bit"), F.col("id").alias("start"))).alias("members"))
    out = sets.select("grp", "id", F.explode(F.array(*new)).alias("x")).where("x.bits != 0").join(members, "grp")
    return out.select("id", "x.distance", F.explode(F.filter("members", lambda m: F.getbit(F.col("x.bits"), m.bit) == 1)).alias("m")).select("m.start", "id", "distance")
