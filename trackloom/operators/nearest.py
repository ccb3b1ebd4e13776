"""The nearest vectors by cosine, all pairs scored by matrix products of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most queries and rows of a block, which a task scores against each other.
QUERIES, ROWS = 32_768, 65_536
#: What ranks after and before all cosines: none (no vector, or one of length 0), and no number.
NONE, NAN = -2.0, 2.0
#: Products that are added up in another order differ by less than this.
NEAR = 1e-9


def _units(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as doubles (null: zeros), their squares added up in order, and the vectors of length one."""
    v = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        if x is not None:
            v[i] = x
    squares = np.zeros(len(v))
    for c in v.T:
        squares += c * c
    return v, squares, v / np.sqrt(squares)[:, None]


def _rank(c: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    return np.where(denominator == 0, NONE, np.where(np.isnan(c), NAN, c))


def _best(query: np.ndarray, row: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of each query, of equal ones the smaller rows."""
    order = np.lexsort((row, -c, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=int)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, ``key``, cosine: the ``k`` other rows with the greatest cosine of each query (ties: the smaller key); vectors are equally long.

    Blocks of queries meet blocks of rows. A matrix product tells which rows of
    a block may be among its best; only these get the cosine added up in
    the order of the entries, which decides. A pair of blocks leaves ``k`` rows a
    query. Null vectors, those with a null and those of length 0 have a null cosine, which comes last.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    n_queries, n_rows = queries.count(), rows.count()
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_r = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // ROWS), min(at_once, n_rows // 1024))
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector)).alias("v")
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    left = queries.select(F.col(key).alias("query"), whole, part(n_q).alias("_q")).crossJoin(F.broadcast(spark.range(n_r).toDF("_r")))
    right = rows.select(F.col(key).alias("row"), whole, part(n_r).alias("_r")).crossJoin(F.broadcast(spark.range(n_q).toDF("_q")))

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], key: [], "cosine": []})
        width = max((len(x) for part in (a["v"], b["v"]) for x in part if x is not None), default=0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            (av, a2, au), (bv, b2, bu) = _units(a["v"], width), _units(b["v"], width)
            asked, there, m, found = a["query"].to_numpy(), b["row"].to_numpy(), min(k, len(b)), []
            for low in range(0, len(a), 64):
                high = low + 64
                c = _rank(au[low:high] @ bu.T, a2[low:high, None] * b2)
                c[asked[low:high, None] == there] = -np.inf
                floor = np.partition(c, len(b) - m, axis=1)[:, len(b) - m]
                i, j = np.nonzero((c >= floor[:, None] - NEAR) & (c > -np.inf))
                for some in np.array_split(np.arange(len(i)), max(1, -(-len(i) // 65_536))):  # copies may be many
                    p, q, dot = i[some] + low, j[some], np.zeros(len(some))
                    for d in range(width):
                        dot += av[p, d] * bv[q, d]
                    size = a2[p] * b2[q]
                    one = (asked[p], there[q], _rank(dot / np.sqrt(size), size))
                    keep = _best(*one, k)
                    found.append([x[keep] for x in one])
        query, row, c = (np.concatenate(x) for x in zip(*found))
        keep = _best(query, row, c, k)
        return pd.DataFrame({"query": query[keep], key: row[keep], "cosine": c[keep]})

    out = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(scored, f"query {kind}, {key} {kind}, cosine double")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    c = F.col("cosine")
    value = F.when(c == NONE, F.lit(None)).when(c == NAN, F.lit(float("nan"))).otherwise(c)
    return out.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).select("query", key, value.alias("cosine"))
