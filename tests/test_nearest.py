import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.operators import nearest
from trackloom.plans import stat_queries


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 4)
    monkeypatch.setattr(nearest, "ROWS", 30)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (120, 6)).astype(float))]  # many equal cosines
    rows += [(200, [0.0] * 6), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (210, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = df.where("id % 10 = 0")
    both = df.join(asked.toDF("query", "e"), F.col("query") != F.col("id")).select("query", "id", geo.cosine(F.col("e"), F.col("v")).alias("cosine"))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    want = both.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")
    got = nearest.nearest_vectors(asked, df, "id", "v", 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pairs_are_no_rows(spark):
    plan = stat_queries.cosine_top(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "aggregate(" not in plan
