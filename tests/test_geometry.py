import math

from pyspark.sql import functions as F

from trackloom.functions import geometry as geo
from trackloom.sources import sinks, summary


def points(*ps):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_codec(spark):
    ps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(3, 4), (4, 4), (4, 5), (3, 5), (3, 4)]])
    code = one(spark, geo.encode_outline(ps))
    assert (code.x, code.y, code.n) == (3, 4, 4)
    back = one(spark, geo.decode_outline(F.lit(3), F.lit(4), F.lit(4), F.lit(code.code)))
    assert [(p.x, p.y) for p in back] == [(3, 4), (4, 4), (4, 5), (3, 5), (3, 4)]
    assert len(one(spark, geo.decode_outline(F.lit(3), F.lit(4), F.lit(0), F.lit(code.code)))) == 1
    jump = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0).alias("y")) for x in (0, 2)])
    assert one(spark, geo.encode_outline(jump)) is None
    ext = one(spark, geo.outline_extent(F.lit(3), F.lit(4), F.lit(4), F.lit(code.code)))
    assert (ext.steps, ext.x, ext.y, ext.x_max, ext.y_max) == (4, 3, 4, 4, 5)


def test_lines(spark):
    assert one(spark, geo.polyline_length(points((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)))) == 40
    assert one(spark, geo.curvature(points(*[(i, 0) for i in range(6)]))) == 0
    half = [(10 * math.cos(a * math.pi / 49), 10 * math.sin(a * math.pi / 49)) for a in range(50)]
    assert abs(one(spark, geo.curvature(points(*half))) - 0.1) < 1e-9
    line = [(i, 0) for i in range(10)]
    along = points(*[(x + 0.1, y) for x, y in line])
    across = points(*[(x, y + 0.1) for x, y in line])
    assert abs(one(spark, geo.displacement_along(points(*line), along)) + 0.9) < 1e-9
    assert abs(one(spark, geo.displacement_along(points(*line), along, True))) < 1e-9
    assert abs(one(spark, geo.displacement_along(points(*line), across))) < 1e-9
    assert abs(one(spark, geo.displacement_along(points(*line), across, True)) - 0.9) < 1e-9
    p = points((1, 0), (0, 1), (-1, 0))
    c = one(spark, geo.circle_through(p[0], p[1], p[2]))
    assert abs(c.x) < 1e-12 and abs(c.r - 1) < 1e-12
    assert one(spark, geo.time_key(F.lit(1.5))) == "1?500"


def test_summary(spark):
    lines = ["0 0.000 2 x %% 0 1 0 2", "1 0.100 2 x %% 1 3 1 4 %%% 1 0.0 2 0.31", "2 0.200 2 x"]
    frames = summary.summary_frames(spark.createDataFrame([(s,) for s in lines], "value string"))
    lives = {r.bid: (r.born_f, r.died_f) for r in summary.births_and_deaths(frames).collect()}
    assert lives == {1: (0, 1), 2: (0, 2), 3: (1, 2), 4: (1, 2)}
    assert [(p.a, p.b) for p in frames.where("frame = 1").first().places] == [("1", "0.0"), ("2", "0.31")]
    rows = spark.createDataFrame([("f", 0, "% 7"), ("f", 1, "1 0.1"), ("f", 2, "2 0.2 %% 1 2 3 abc"), ("f", 3, "% 8"), ("f", 4, "1 0.1")], "file string, n int, value string")
    got = summary.with_header(rows, "file", "n").orderBy("n").collect()
    assert [r.bid for r in got] == [7, 7, 8]
    assert one(spark, summary.outline_fields(F.lit("2 0.2 %% 1 2 3 abc"))).code == "abc"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (1, 3.0)], "bid long, x double")
    sinks.write_by_key(df, str(tmp_path / "t"), buckets=4)
    assert sorted(r.x for r in sinks.read_by_key(spark, str(tmp_path / "t"), 1, 4).collect()) == [1.0, 3.0]
    changed = sinks.upsert(df, spark.createDataFrame([(1, 9.0)], "bid long, x double"), ["bid"])
    assert sorted((r.bid, r.x) for r in changed.collect()) == [(1, 9.0), (2, 2.0)]
    nodes = spark.createDataFrame([(1, 0, 5), (2, 6, 9)], "node_id long, born_f long, died_f long")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    events = sinks.lost_and_found(nodes, edges)
    assert sorted((r.frame, r.a, r.b) for r in events.collect()) == [(0, 0, 1), (5, 1, 2), (9, 2, 0)]
    heads = spark.createDataFrame([(0, "0 0.0"), (5, "5 0.5"), (9, "9 0.9")], "frame long, head string")
    lines = {r.frame: r.line for r in sinks.summary_lines(events, heads, nodes.where("node_id = 1").select("node_id")).collect()}
    assert lines == {0: "0 0.0 %% 0 1", 5: "5 0.5 %% 1 0", 9: "9 0.9"}
