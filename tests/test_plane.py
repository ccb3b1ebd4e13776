"""Functions on boxes, outlines and arrays, and readers of files, against plain Python."""

import json
import math
import os
import random

from pyspark.sql import functions as F

from trackloom.functions import plane
from trackloom.operators import readings

BOX = "struct<x_min:double,x_max:double,y_min:double,y_max:double>"
LINE = "array<struct<x:double,y:double>>"


def test_boxes(spark):
    r = random.Random(4)
    boxes = [tuple(v for _ in "xy" for v in sorted((r.randrange(9) / 2, r.randrange(9) / 2))) for _ in range(60)] + [(1.0, 1.0, 2.0, 2.0)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(boxes, boxes[1:] + boxes[:1]))] + [(99, None, boxes[0])], f"id int, a {BOX}, b {BOX}")
    a, b = F.col("a"), F.col("b")
    got = {x.id: x for x in rows.select("id", plane.aspect(a).alias("aspect"), plane.grown(a, 0.5).alias("grown"), plane.contains(a, b).alias("contains"), plane.squared(a).alias("squared")).collect()}
    for k, (a, b) in enumerate(zip(boxes, boxes[1:] + boxes[:1])):
        x0, x1, y0, y1 = a
        assert got[k].aspect == ((x1 - x0) / (y1 - y0) if y1 > y0 else None)
        assert tuple(got[k].grown) == (x0 - 0.5, x1 + 0.5, y0 - 0.5, y1 + 0.5)
        assert got[k].contains == (x0 <= b[0] and b[1] <= x1 and y0 <= b[2] and b[3] <= y1)
        s = tuple(got[k].squared)
        side = max(x1 - x0, y1 - y0)
        assert (s[1] - s[0], s[3] - s[2], s[0] + s[1], s[2] + s[3]) == (side, side, x0 + x1, y0 + y1)
    assert got[99].aspect is None and got[99].contains is None


def test_outlines_and_regions(spark):
    lines = [[], [(1.0, 2.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*lines, None])], f"id int, line {LINE}")
    line = F.col("line")
    region = plane.region_points(F.when(F.col("id") == 1, "circle").when(F.col("id") == 2, "polygon").otherwise("point"), F.lit(3.0), F.lit(4.0), F.lit(2.0), line, 8)
    got = {x.id: x for x in rows.select("id", plane.closed(line).alias("closed"), plane.or_centroid(line, F.lit(7.0), F.lit(8.0)).alias("some"), region.alias("region")).collect()}
    for k, v in enumerate(lines):
        assert list(map(tuple, got[k].closed)) == (v if not v or v[0] == v[-1] else [*v, v[0]])
        assert list(map(tuple, got[k].some)) == (v or [(7.0, 8.0)])
    assert got[4].closed is None and list(map(tuple, got[4].some)) == [(7.0, 8.0)]
    circle = got[1].region
    assert len(circle) == 9 and all(abs(math.hypot(p.x - 3, p.y - 4) - 2) < 1e-12 for p in circle) and math.dist(circle[0], circle[-1]) < 1e-12
    assert list(map(tuple, got[2].region)) == lines[2] and got[3].region is None


def test_padded_arrays(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, []), (3, [1.0, 2.0, 3.0, 4.0])], "id int, v array<double>")
    assert {x.id: x.p for x in rows.select("id", plane.padded(F.col("v"), 3).alias("p")).collect()} == {1: [1.0, None, None], 2: [None] * 3, 3: [1.0, 2.0, 3.0, 4.0]}


def test_matrices_and_folders(spark, tmp_path):
    rows = [[1.5, 2.0], [3.0], [-4.25, 1e20, 0.0]]
    path = str(tmp_path / "matrix")
    readings.write_matrix(spark.createDataFrame([(r,) for r in rows], "v array<double>"), "v", path)
    assert sorted(r.row for r in readings.matrix_rows(spark, path).collect()) == sorted(rows)
    with open(tmp_path / "own.txt", "w") as f:
        f.write("  1 2\t3 \n\n x 5\n")
    assert [r.row for r in readings.matrix_rows(spark, str(tmp_path / "own.txt")).collect()] == [[1.0, 2.0, 3.0], [None, 5.0]]
    (tmp_path / "in").mkdir()
    for name, size in (("a.bin", 3), ("b.bin", 1), ("empty.bin", 0)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    assert {os.path.basename(r.file): r.size for r in readings.datasets(spark, str(tmp_path / "in")).collect()} == {"a.bin": 3, "b.bin": 1}
    (tmp_path / "info.json").write_text(json.dumps({"name": "one", "scale": 2.5}, indent=2))
    assert [(r.name, r["scale"]) for r in readings.recording_info(spark, str(tmp_path / "info.json")).collect()] == [("one", 2.5)]
