import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import flags


def test_normal_fit():
    r = np.random.default_rng(1)
    n, edges = np.histogram(r.normal(10, 2, 20_000), 100)
    mean, std = flags.fit_normal((edges[1:] + edges[:-1]) / 2, n.astype(float))
    assert abs(mean - 10) < 0.1 and abs(std - 2) < 0.1
    low, high = flags.extreme_thresholds(0.0, 1.0, 1000)
    assert 3.5 < high < 4.2 and abs(low + high) < 1e-9


def test_outliers(spark):
    r = np.random.default_rng(2)
    values = [*r.normal(10, 1, 200), *r.normal(20, 1, 12), *r.normal(1, 0.5, 8)]
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)] + [(900, None), (901, float("nan"))], "i long, v double")
    got = {x.i: x for x in flags.outlier_flags(df, "v").collect()}
    assert all(got[k].ok for k in range(200)) and not any(got[k].ok_long for k in range(200, 212)) and not any(got[k].ok_short for k in range(212, 220))
    assert all(got[k].ok_short for k in range(200, 212)) and not got[900].ok and not got[901].ok
    zeros = spark.createDataFrame([(k, 0.0) for k in range(6)] + [(7, 1.0)], "i long, v double")
    assert flags.outlier_flags(zeros, "v").where("ok").count() == 0
    assert flags.outlier_flags(df.limit(0), "v").count() == 0


def test_resample(spark):
    ps = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (1, 0), (1, 3)]])
    got = spark.range(1).select(flags.resample(ps, 5).alias("p")).first().p
    assert [(p.x, p.y) for p in got] == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert spark.range(1).select(flags.resample(F.slice(ps, 1, 1), 5).alias("p")).first().p is None
