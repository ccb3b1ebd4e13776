"""Statistics: two-sample tests, entropies, movement measures, regressions, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.series import turn


def running_totals(df: DataFrame, value: str, columns: list[str], width: float, keys: list[str] | None = None) -> DataFrame:
    """``df`` (one row a key and value) with run_<column>: sums up to and with this value.

    Values are cut into steps of ``width``: sums run inside each step, and over
    the steps' totals, so no task orders all values.
    """
    keys = keys or []
    df = df.withColumn("_step", F.floor(F.col(value) / width))
    inside = Window.partitionBy(*keys, "_step").orderBy(value)
    across = Window.partitionBy(*keys, F.lit(0)).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_step").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    totals = totals.select(*keys, "_step", *[F.coalesce(F.sum(f"_t_{c}").over(across), F.lit(0)).alias(f"_b_{c}") for c in columns])
    out = df.join(totals, [*keys, "_step"]).withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"_b_{c}") for c in columns})
    return out.drop("_step", *[f"_b_{c}" for c in columns])


def exact_quantiles(df: DataFrame, column: str, shares: list[float], steps: int = 1024) -> DataFrame:
    """share, value of a whole column, linear between neighbours; nulls are left out, and without values there are no rows.

    Equal values are counted first and ranks come from ``running_totals``, so
    unlike a global percentile no task holds all distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    low, high, n = counts.agg(F.min("v"), F.max("v"), F.sum("c")).first()
    ranks = [(float(p), end, int(f)) for p in shares for end, f in (("low", (n or 1) * p - p), ("high", -(-((n or 1) * p - p) // 1)))]
    wanted = F.array(*[F.struct(F.lit(p).alias("share"), F.lit(end).alias("end"), F.lit(k).cast("long").alias("k")) for p, end, k in ranks])
    run = running_totals(counts, "v", ["c"], ((high or 0) - (low or 0)) / steps or 1.0)
    at = run.select("v", F.explode(F.filter(wanted, lambda t: (t.k >= F.col("run_c") - F.col("c")) & (t.k < F.col("run_c")))).alias("t"))
    ends = at.groupBy("t.share").agg(F.max(F.when(F.col("t.end") == "low", F.col("v"))).alias("a"), F.max(F.when(F.col("t.end") == "high", F.col("v"))).alias("b"))
    part = F.col("share") * ((n or 1) - 1) - F.floor(F.col("share") * ((n or 1) - 1))
    return ends.select("share", (F.col("a") + part * (F.col("b") - F.col("a"))).alias("value"))


def ks_two_sample(df: DataFrame, value: str, is_first: Column, width: float) -> DataFrame:
    """One row: n1, n2 and the largest distance of the two samples' distribution functions. Null values are left out."""
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    totals = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    run = running_totals(counts, "v", ["a", "b"], width).crossJoin(F.broadcast(totals))  # one row
    return run.groupBy("n1", "n2").agg(F.max(F.abs(F.try_divide(F.col("run_a"), F.col("n1")) - F.try_divide(F.col("run_b"), F.col("n2")))).alias("ks"))


MOST_COLUMNS = 24  # samples whose counts are columns


def ks_all_pairs(df: DataFrame, value: str, sample: str, width: float) -> DataFrame:
    """one, two, ks for each pair of samples.

    Up to ``MOST_COLUMNS`` samples are columns: one running total of all of them
    and one aggregate. Beyond that each value gets a row for every sample.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(sample).isNotNull()).groupBy(F.col(value).alias("v"), F.col(sample).alias("sample")).agg(F.count("*").alias("c"))
    names = counts.select("sample").distinct()
    found = sorted(r[0] for r in names.limit(MOST_COLUMNS + 1).collect())
    if len(found) <= MOST_COLUMNS:
        cells = [f"c{k}" for k in range(len(found))]
        wide = counts.groupBy("v").agg(*[F.sum(F.when(F.col("sample") == n, F.col("c")).otherwise(0)).alias(c) for n, c in zip(found, cells)]) if found else counts.select("v").limit(0)
        totals = wide.agg(*[F.sum(c).alias(f"n_{c}") for c in cells]).first() if found else ()
        share = [F.col(f"run_{c}") / n for c, n in zip(cells, totals)]
        pairs = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found))]
        if not pairs:
            kind = df.schema[sample].dataType
            return names.select(F.col("sample").cast(kind).alias("one"), F.col("sample").cast(kind).alias("two"), F.lit(0.0).alias("ks")).limit(0)
        far = running_totals(wide, "v", cells, width).agg(*[F.max(F.abs(share[i] - share[j])).alias(f"k{i}_{j}") for i, j in pairs])
        rows = F.array(*[F.struct(F.lit(found[i]).alias("one"), F.lit(found[j]).alias("two"), F.col(f"k{i}_{j}").alias("ks")) for i, j in pairs])
        return far.select(F.explode(rows).alias("p")).select("p.*")
    grid = counts.select("v").distinct().crossJoin(names).join(counts, ["v", "sample"], "left").na.fill(0, ["c"])
    cdf = running_totals(grid, "v", ["c"], width, ["sample"]).join(counts.groupBy("sample").agg(F.sum("c").alias("n")), "sample").select("v", "sample", (F.col("run_c") / F.col("n")).alias("p"))
    a, b = cdf.toDF("v", "one", "p1"), cdf.toDF("v", "two", "p2")
    return a.join(b, "v").where("one < two").groupBy("one", "two").agg(F.max(F.abs(F.col("p1") - F.col("p2"))).alias("ks"))


def ks_p_value(ks: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic probability of a distance at least this large."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    t = (root + 0.12 + 0.11 / root) * ks
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * t * t * k * k))
    return F.least(F.greatest(F.when(t < 0.2, 1.0).otherwise(total), F.lit(0.0)), F.lit(1.0))


def excess_entropy(df: DataFrame, key: str, symbol: str) -> DataFrame:
    """key, entropy: bits by which an object's symbols fall short of an even spread over those it has."""
    counts = df.groupBy(key, symbol).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(key))
    return counts.withColumn("p", p).groupBy(key).agg((F.log2(F.count("*")) + F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def markov_measures(df: DataFrame, key: str = "bid", order: str = "frame", dt: float = 1.0) -> DataFrame:
    """reversal, speed, acceleration and turn between the two last steps of each row; null where there aren't two."""
    w = Window.partitionBy(key).orderBy(order)
    d = lambda c, k: F.lag(c, k).over(w) - F.lag(c, k + 1).over(w) if k else F.col(c) - F.lag(c).over(w)
    df = df.withColumns({"_ax": d("x", 1), "_ay": d("y", 1), "_bx": d("x", 0), "_by": d("y", 0)})
    a, b = F.hypot("_ax", "_ay"), F.hypot("_bx", "_by")
    inner = F.col("_ax") * F.col("_bx") + F.col("_ay") * F.col("_by")
    cross = F.col("_ax") * F.col("_by") - F.col("_ay") * F.col("_bx") + 0.0
    return df.withColumns({"reversal": inner < 0, "speed": b / dt, "acceleration": (b - a) / (dt * dt), "turn": turn(cross, inner)}).drop("_ax", "_ay", "_bx", "_by")


def regression_lines(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def derivative(df: DataFrame, y: str, x: str, key: str, order: str) -> DataFrame:
    """slope and bend by central differences; null at both ends."""
    w = Window.partitionBy(key).orderBy(order)
    dx = (F.lead(x).over(w) - F.lag(x).over(w)) / 2
    slope = F.try_divide(F.lead(y).over(w) - F.lag(y).over(w), 2 * dx)
    second = F.try_divide(F.lead(y).over(w) - 2 * F.col(y) + F.lag(y).over(w), dx * dx)
    return df.withColumns({"slope": slope, "bend": second / F.pow(1 + slope * slope, F.lit(1.5))})


def integral(df: DataFrame, y: str, x: str, key: str, order: str) -> DataFrame:
    """area: trapezoids from a series' first row on."""
    w = Window.partitionBy(key).orderBy(order)
    part = F.coalesce((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2, F.lit(0.0))
    return df.withColumn("_part", part).withColumn("area", F.sum("_part").over(w)).drop("_part")


def standardise(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Columns less their mean, over their sample deviation (of the key)."""
    stats = df.groupBy(*(keys or [])).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def principal_components(df: DataFrame, vector: str, k: int):
    """(fitted model, df with scores as an array): Spark's own PCA on centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    rows = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(rows)
    return model, model.transform(rows).withColumn("scores", vector_to_array("_p")).drop("_v", "_c", "_p")


def interval_overlaps(found: DataFrame, truth: DataFrame, key: str, width: float) -> DataFrame:
    """key, t_start, t_end of each true interval, with hits and the covered share: found, truth (key, start, end).

    An interval is dealt to all steps of ``width`` that it touches; a pair is
    taken in the step where its overlap starts.
    """
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    t = truth.select(key, F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    f = found.select(key, F.col("start").alias("f_start"), F.col("end").alias("f_end")).withColumn("_step", steps("f_start", "f_end"))
    low, high = F.greatest("t_start", "f_start"), F.least("t_end", "f_end")
    pairs = t.withColumn("_step", steps("t_start", "t_end")).join(f, [key, "_step"]).where((low <= high) & (F.col("_step") == F.floor(low / width)))
    met = pairs.groupBy(key, "t_start", "t_end").agg(F.count("*").alias("hits"), F.sum(high - low).alias("covered"))
    out = t.distinct().join(met, [key, "t_start", "t_end"], "left")
    return out.select(key, "t_start", "t_end", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(F.try_divide(F.col("covered"), F.col("t_end") - F.col("t_start")), F.lit(0.0)).alias("share"))


def confusion(found: Column, truth: Column) -> list[Column]:
    """Counts, rates, precision and F1 of flags, as aggregates."""
    tp, fp, tn, fn = (F.count_if(c) for c in (found & truth, found & ~truth, ~found & ~truth, ~found & truth))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), recall.alias("tpr"), F.try_divide(fp, fp + tn).alias("fpr"), precision.alias("precision"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]
