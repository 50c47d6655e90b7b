"""offset_polyline gives the whole parallel of every way, by brute force."""

import os

import pytest

from roadloom.plans import bridge as B
from roadloom.plans import catalogue_more

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def parallel(line, d):
    line = [p for i, p in enumerate(line) if not i or p != line[i - 1]]
    normals = []
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        size = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        normals.append((-(y1 - y0) / size, (x1 - x0) / size))
    out = []
    for i, (x, y) in enumerate(line if normals else []):
        a, b = normals[max(0, i - 1)], normals[min(i, len(normals) - 1)]
        n = a[0] + b[0], a[1] + b[1]
        size = (n[0] ** 2 + n[1] ** 2) ** 0.5
        n = (n[0] / size, n[1] / size) if size > 1e-9 else a
        out.append((x + d * n[0], y + d * n[1]))
    return out


def test_parallels_of_all_ways(spark):
    want = {r.way_id: parallel([(p.x, p.y) for p in r.line], 2.0) for r in B.lines(spark, DATA).collect()}
    want = {w: line for w, line in want.items() if line}
    got = {r.way_id: r for r in catalogue_more.offset_polyline(spark, DATA).collect()}
    assert got.keys() == want.keys() and max(map(len, want.values())) > 2
    for w, line in want.items():
        r = got[w]
        assert [c for p in r.line for c in p] == pytest.approx([c for p in line for c in p], abs=1e-4)
        assert (r.sx, r.sy, r.ex, r.ey) == pytest.approx((*line[0], *line[-1]), abs=1e-4)


def test_repeated_points(spark):
    from pyspark.sql import functions as F

    from roadloom.functions import polyline as P

    line = [(0.0, 0.0), (0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    df = spark.createDataFrame([(line,)], "line array<struct<x double, y double>>")
    got = df.select(P.offset(F.col("line"), 2.0).alias("o")).first().o
    assert [c for p in got for c in p] == pytest.approx([c for p in parallel(line, 2.0) for c in p])
