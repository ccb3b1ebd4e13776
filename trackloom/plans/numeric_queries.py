"""Queries on special functions, regressions, synthetic series and component read-outs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackloom.functions import special
from trackloom.operators import loadings, regressions
from trackloom.plans.registry import query
from trackloom.sources.tracks import S_SQL, observations, table, with_segments

r6 = lambda c: F.round(c, 6) + 0.0
A, X = "(1 + o_orderkey % 9) / 2.0", "(o_orderkey % 31) / 2.0"
GAMMA_P = "CASE WHEN {x} = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, 240), lambda n: exp(-({x}) + ({a} + n) * ln({x}) - lgamma({a} + n + 1)))) END"


@query("SELECT l_orderkey, l_linenumber, round(lgamma(l_quantity / 4), 6) + 0.0 AS value FROM lineitem")
def log_gamma(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(special.log_gamma(F.col("l_quantity") / 4)).alias("value"))


@query(f"SELECT o_orderkey, round({GAMMA_P.format(a=A, x=X)}, 6) + 0.0 AS p, round(1 - {GAMMA_P.format(a=A, x=X)}, 6) + 0.0 AS q FROM orders")
def incomplete_gamma(spark, sf_dir):
    a, x = (1 + F.col("o_orderkey") % 9) / 2.0, (F.col("o_orderkey") % 31) / 2.0
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(special.gamma_p(a, x)).alias("p"), r6(special.gamma_q(a, x)).alias("q"))


Z = "(p_size - 25) / 8.0"


@query(f"SELECT p_partkey, round(exp(-({Z}) * ({Z}) / 2) / sqrt(2 * pi()), 6) + 0.0 AS pdf, round(0.5 + 0.5 * sign({Z}) * {GAMMA_P.format(a='0.5', x=f'(({Z}) * ({Z}) / 2)')}, 6) + 0.0 AS cdf FROM part")
def normal_distribution(spark, sf_dir):
    z = (F.col("p_size") - 25) / 8.0
    return table(spark, sf_dir, "part").select("p_partkey", r6(special.normal_pdf(z)).alias("pdf"), r6(special.normal_cdf(z)).alias("cdf"))


BETA = "CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 ELSE list_sum(list_transform(range(0, 3000), lambda j: exp(lgamma(a + b + j) - lgamma(a + 1 + j) - lgamma(b) + (a + j) * ln(x) + b * ln(1 - x)))) END"


@query(f"SELECT p_partkey, round({BETA}, 5) + 0.0 AS value FROM (SELECT p_partkey, (1 + p_partkey % 7) / 2.0 AS a, (1 + p_partkey % 5) / 2.0 AS b, p_size / 51.0 AS x FROM part)")
def incomplete_beta(spark, sf_dir):
    value = special.beta_i((1 + F.col("p_partkey") % 7) / 2.0, (1 + F.col("p_partkey") % 5) / 2.0, F.col("p_size") / 51.0)
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(value, 5) + 0.0).alias("value"))


@query("SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST((embedding[i] > 0) <> (i % 2 = 1) AS INT))) AS distance FROM embeddings")
def hamming_distance(spark, sf_dir):
    target = F.array(*[F.lit(k % 2 == 0) for k in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", special.hamming(F.transform("embedding", lambda v: v > 0), target).cast("long").alias("distance"))


@query("""SELECT l_suppkey, regr_count(ln(l_extendedprice), l_quantity) AS n, round(regr_slope(ln(l_extendedprice), l_quantity), 6) + 0.0 AS slope, round(exp(regr_intercept(ln(l_extendedprice), l_quantity)), 3) + 0.0 AS factor,
round(regr_r2(ln(l_extendedprice), l_quantity), 6) + 0.0 AS r2 FROM lineitem GROUP BY l_suppkey""")
def log_linear(spark, sf_dir):
    fit = regressions.log_linear(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return fit.select("l_suppkey", "n", r6("slope").alias("slope"), (F.round("factor", 3) + 0.0).alias("factor"), r6("r2").alias("r2"))


@query("""SELECT l_suppkey, regr_count(ln(l_extendedprice), ln(l_quantity)) AS n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) + 0.0 AS slope, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) + 0.0 AS factor,
round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) + 0.0 AS r2 FROM lineitem GROUP BY l_suppkey""")
def log_log(spark, sf_dir):
    fit = regressions.log_log(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return fit.select("l_suppkey", "n", r6("slope").alias("slope"), (F.round("factor", 3) + 0.0).alias("factor"), r6("r2").alias("r2"))


SUMS = f"""{S_SQL}, q AS (SELECT bid, CAST(floor(frame / 8) AS BIGINT) AS part, frame, x FROM s), k AS (
  SELECT bid, part, regr_count(x, frame) AS n, regr_sxx(x, frame) AS sxx, regr_syy(x, frame) AS syy, regr_sxy(x, frame) AS sxy FROM q GROUP BY bid, part
)"""


@query(f"WITH {SUMS} SELECT bid, part, n, round(sxx + 1e-7, 4) + 0.0 AS sxx, round(syy + 1e-7, 4) + 0.0 AS syy, round(sxy + 1e-7, 4) + 0.0 AS sxy FROM k")
def slope_sums(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("part", F.floor(F.col("frame") / 8))
    return regressions.slope_sums(rows, ["bid", "part"], "frame", "x").select("bid", "part", "n", *[(F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c) for c in ("sxx", "syy", "sxy")])


@query(f"""WITH {SUMS}, m AS (SELECT a.bid, a.part, a.n + b.n - 4 AS free, a.syy - CASE WHEN a.sxx <> 0 THEN a.sxy ** 2 / a.sxx END + b.syy - CASE WHEN b.sxx <> 0 THEN b.sxy ** 2 / b.sxx END AS apart,
  a.syy + b.syy - CASE WHEN a.sxx + b.sxx <> 0 THEN (a.sxy + b.sxy) ** 2 / (a.sxx + b.sxx) END AS together FROM k a JOIN k b ON b.bid = a.bid AND b.part = a.part + 1),
f AS (SELECT bid, part, free, CASE WHEN free > 0 AND apart <> 0 THEN greatest(together - apart, 0) * free / apart END AS f FROM m), h AS (SELECT *, free / (free + f) AS near FROM f),
g AS (SELECT *, CASE WHEN near > 0.5 THEN 0.5 ELSE free / 2.0 END AS a, CASE WHEN near > 0.5 THEN free / 2.0 ELSE 0.5 END AS b, CASE WHEN near > 0.5 THEN 1 - near ELSE near END AS x FROM h),
i AS (SELECT bid, part, f, near, {BETA} AS v FROM g)
SELECT bid, part, round(f, 4) + 0.0 AS f, round(CASE WHEN f IS NULL THEN NULL WHEN near > 0.5 THEN 1 - v ELSE v END, 4) + 0.0 AS p FROM i""")
def compared_slopes(spark, sf_dir):
    """Slopes of blocks of eight rows against the next block."""
    rows = observations(spark, sf_dir).withColumn("part", F.floor(F.col("frame") / 8))
    return regressions.compare_slopes(regressions.slope_sums(rows, ["bid", "part"], "frame", "x"), "bid", "part").select("bid", "part", (F.round("f", 4) + 0.0).alias("f"), (F.round("p", 4) + 0.0).alias("p"))


PIECES = "CAST(2.0 * x - 3.0 * greatest(x - 10, 0) + 1.5 * greatest(x - 25, 0) AS DOUBLE)"
SERIES = f"SELECT s_suppkey, x, {PIECES} AS y FROM supplier, (SELECT unnest(range(0, 40)) AS x)"


def synthetic(spark, sf_dir):
    return regressions.piecewise_series(table(spark, sf_dir, "supplier"), "s_suppkey", 40, [10, 25], [2.0, -1.0, 0.5])


@query(SERIES)
def synthetic_series(spark, sf_dir):
    return synthetic(spark, sf_dir)


STEP = "(({0}) * 1103515245 + 12345) % 2147483648"
NOISE = lambda v: f"(({STEP.format(STEP.format(v))}) + 0.5) / 2147483648"


@query(f"SELECT s_suppkey, x, round(y + 0.5 * sqrt(-2 * ln({NOISE('2 * (s_suppkey * 40 + x)')})) * cos(2 * pi() * {NOISE('2 * (s_suppkey * 40 + x) + 1')}), 6) + 0.0 AS y FROM ({SERIES})")
def noisy_series(spark, sf_dir):
    return regressions.corrupted(synthetic(spark, sf_dir), ["y"], 0.5, F.col("s_suppkey") * 40 + F.col("x")).select("s_suppkey", "x", r6("y").alias("y"))


@query(f"""WITH {S_SQL}, f AS (SELECT bid, segment, min(frame) AS a, max(frame) AS b, regr_slope(x, frame) AS slope, regr_intercept(x, frame) AS intercept FROM s GROUP BY bid, segment HAVING count(*) > 1)
SELECT bid, segment, round(slope, 4) + 0.0 AS slope, a, b, round(a * slope + intercept, 3) + 0.0 AS first, round(b * slope + intercept, 3) + 0.0 AS last FROM f WHERE slope IS NOT NULL""")
def fitted_lines(spark, sf_dir):
    lines = regressions.fitted_lines(with_segments(observations(spark, sf_dir), 14400), ["bid", "segment"], "frame", "x")
    part = lambda k: F.split("line", " ")[k].cast("double")
    return lines.select("bid", "segment", (F.round(F.col("slope").cast("double"), 4) + 0.0).alias("slope"), part(0).cast("long").alias("a"), part(2).cast("long").alias("b"), (part(1) + 0.0).alias("first"), (part(3) + 0.0).alias("last"))


D = 64
BASIS = [[math.sqrt(2 / D) * math.cos(math.pi * (i + 0.5) * k / D) for i in range(D)] for k in range(1, 5)]
MEANS, SPREADS = [0.1] * D, [2.0] * D
STD = "list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - 0.1) / 2.0)"
SCORES = "[" + ", ".join(f"list_dot_product(std, {c})" for c in BASIS) + "]"
COLUMNS = [[c[i] for c in BASIS] for i in range(D)]
P_SQL = f"p AS (SELECT vec_id, label, embedding, std, {SCORES} AS scores FROM (SELECT vec_id, label, embedding, {STD} AS std FROM embeddings)), a AS (SELECT *, [" + ", ".join(f"list_dot_product(scores, {c}) * 2.0 + 0.1" for c in COLUMNS) + "] AS near FROM p)"


def scored(spark, sf_dir):
    return loadings.reconstructions(table(spark, sf_dir, "embeddings"), "embedding", MEANS, SPREADS, BASIS)


def long(df, column):
    return df.select("vec_id", F.posexplode(column).alias("k", "v")).select("vec_id", "k", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {P_SQL} SELECT vec_id, k - 1 AS k, round(scores[k], 5) + 0.0 AS v FROM (SELECT vec_id, scores, unnest(range(1, 5)) AS k FROM p)")
def component_scores(spark, sf_dir):
    return long(scored(spark, sf_dir), "scores")


@query(f"WITH {P_SQL} SELECT vec_id, k - 1 AS k, round(near[k], 5) + 0.0 AS v FROM (SELECT vec_id, near, unnest(range(1, 65)) AS k FROM a)")
def reconstructions(spark, sf_dir):
    return long(scored(spark, sf_dir), "approximation")


@query(f"WITH {P_SQL} SELECT vec_id, round(list_distance(near, CAST(embedding AS DOUBLE[])), 5) + 0.0 AS euclidean, round(1 - list_cosine_similarity(near, CAST(embedding AS DOUBLE[])), 5) + 0.0 AS cosine FROM a")
def reconstruction_distances(spark, sf_dir):
    euclidean, cosine = loadings.distances(F.col("approximation"), F.col("embedding").cast("array<double>"))
    return scored(spark, sf_dir).select("vec_id", (F.round(euclidean, 5) + 0.0).alias("euclidean"), (F.round(cosine, 5) + 0.0).alias("cosine"))


@query(f"WITH {P_SQL} SELECT vec_id, k - 1 AS k, round(scores[2] * c[k] * 2.0 + 0.1, 5) + 0.0 AS v FROM (SELECT vec_id, scores, {BASIS[1]} AS c, unnest(range(1, 65)) AS k FROM p)")
def one_component(spark, sf_dir):
    return long(loadings.reconstructions(table(spark, sf_dir, "embeddings"), "embedding", MEANS, SPREADS, BASIS, only=1), "approximation")


@query("SELECT k - 1 AS \"column\", vec_id AS row, embedding[k] AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)")
def transposed(spark, sf_dir):
    return loadings.transposed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"WITH {P_SQL} SELECT label, k - 1 AS component, round(avg(scores[k]), 5) + 0.0 AS mean, round(stddev_pop(scores[k]), 5) + 0.0 AS spread, count(*) AS n FROM (SELECT label, scores, unnest(range(1, 5)) AS k FROM p) GROUP BY label, k")
def cluster_loadings(spark, sf_dir):
    found = loadings.cluster_loadings(scored(spark, sf_dir), "label", "scores")
    return found.select("label", "component", (F.round("mean", 5) + 0.0).alias("mean"), (F.round("spread", 5) + 0.0).alias("spread"), "n")
