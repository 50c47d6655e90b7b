"""Closed forms of geometry and tags."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import polyline as P
from roadloom.functions import tags as T
from roadloom.operators import graphs, joins, quality, raster
from roadloom.plans.catalogue_more import _spiral, simplified

LINE = "array<struct<x: double, y: double>>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_length_and_points(spark):
    bent = line((0, 0), (3, 4), (3, 10))
    assert one(spark, P.length(bent)) == 11
    assert one(spark, P.point_at(bent, F.lit(8.0))) == (3, 7)
    assert [tuple(p) for p in one(spark, P.resample(bent, F.lit(11.0), 3))] == [(0, 0), (3, 4.5), (3, 10)]
    assert one(spark, P.length(line((1, 1)))) == 0
    assert one(spark, P.point_at(line((1, 1), (1, 1)), F.lit(5.0))) == (1, 1)


def test_projection_of_a_point(spark):
    got = one(spark, P.project(line((0, 0), (10, 0), (10, 10)), F.lit(12.0), F.lit(5.0)))
    assert got.distance == pytest.approx(2) and got.station == pytest.approx(15)


def test_rings(spark):
    square = line((0, 0), (4, 0), (4, 4), (0, 4))
    assert one(spark, P.ring_area(square)) == 16
    assert one(spark, P.ring_area(F.reverse(square))) == -16
    assert one(spark, raster.in_ring(square, F.lit(1.0), F.lit(1.0)))
    assert not one(spark, raster.in_ring(square, F.lit(5.0), F.lit(1.0)))


@pytest.mark.parametrize(("dx", "dy", "bit"), [(1, 0, 1), (1, 1, 2), (0, 1, 4), (-1, 1, 8), (-1, 0, 16), (-1, -1, 32), (0, -1, 64), (1, -1, 128)])
def test_direction_bits(spark, dx, dy, bit):
    assert one(spark, P.direction_bit(F.lit(float(dx)), F.lit(float(dy)))) == bit


def test_arcs_and_spirals(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, P.arc(*lit(3, 4, 0, 0, 2))) == (5, 4)
    got = one(spark, P.arc(*lit(0, 0, 0, 0.1, 10 * math.pi / 2)))
    assert got.x == pytest.approx(10) and got.y == pytest.approx(10)
    import pyarrow as pa

    rows = {"way_id": [1], "x": [0.0], "y": [0.0], "h": [0.0], "k0": [0.0], "k1": [0.05], "s": [40.0]}
    end = next(_spiral([pa.record_batch(rows)])).to_pylist()[0]
    steps = 200_000
    t = (np.arange(steps) + 0.5) * 40 / steps
    angle = 0.05 / 40 * t * t / 2
    assert end["px"] == pytest.approx(np.cos(angle).mean() * 40, abs=1e-6) and end["py"] == pytest.approx(np.sin(angle).mean() * 40, abs=1e-6)


def test_utm_of_known_points(spark):
    def at(lon, lat, zone):
        e, n = P.utm(F.lit(lon), F.lit(lat), F.lit(float(zone)))
        return one(spark, e), one(spark, n)

    assert at(9.0, 0.0, 32) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    # the meridian arc from the equator to 45 degrees is 4984944.378 m
    assert at(9.0, 45.0, 32)[1] == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    assert at(9.0, -45.0, 32)[1] == pytest.approx(1e7 - 0.9996 * 4984944.378, abs=0.01)


def test_simplification_and_offset(spark):
    assert simplified(np.array([(0, 0), (1, 0.01), (2, 0), (2, 5)]), 0.1).tolist() == [0, 2, 3]
    assert simplified(np.array([(1, 1), (1, 1)]), 0.1).tolist() == [0, 1]
    got = one(spark, P.offset(line((0, 0), (10, 0)), 2.0))
    assert [tuple(p) for p in got] == [(0, 2), (10, 2)]


@pytest.mark.parametrize(("text", "metres"), [("3.5", 3.5), ("3.5 m", 3.5), ("10 ft", 3.048), ("6'6\"", 1.9812), ("unknown", None), ("0", None), (None, None)])
def test_lengths(spark, text, metres):
    got = one(spark, T.metres(F.lit(text).cast("string")))
    assert got == (pytest.approx(metres) if metres is not None else None)


@pytest.mark.parametrize(("text", "speed"), [("36", 10), ("walk", 7 / 3.6), ("none", 250 / 3.6), ("signals", None), ("10 mph", 16.09344 / 3.6), ("motorway", 120 / 3.6), ("odd", None), (None, None)])
def test_speeds(spark, text, speed):
    got = one(spark, T.speed(F.lit(text).cast("string")))
    assert got == (pytest.approx(speed) if speed is not None else None)


def test_lane_counts(spark):
    rows = [
        (1, 2, None, None, True, "primary", (2, 2, 0, True)),
        (2, None, None, None, None, "motorway", (6, 3, 3, False)),
        (3, None, None, None, True, "motorway", (3, 3, 0, True)),
        (4, 3, 1, None, None, "primary", (3, 1, 2, False)),
        (5, 2, None, 2, None, "primary", (2, 2, 0, True)),
        (6, 2, None, 1, True, "primary", (2, 1, 1, False)),
        (7, 1, 2, 2, None, "primary", (4, 2, 2, False)),
        (8, None, 1, None, None, "primary", (2, 1, 1, False)),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "i int, lanes int, forward int, backward int, oneway boolean, road_class string")
    got = {r.i: (r.lanes, r.forward, r.backward, r.oneway) for r in T.with_lane_counts(df).collect()}
    assert got == {r[0]: r[6] for r in rows}


def test_widths(spark):
    df = spark.createDataFrame([(1, None, None, None, 2, "primary"), (2, "9", "3|3", None, 2, "primary"), (3, None, "3|x", None, 2, "primary"), (4, None, None, "8", 2, "primary")], "i int, width string, width_lanes string, est_width string, lanes int, road_class string")
    got = {r.i: (r.width_m, r.width_basis, r.lane_widths, r.estimated) for r in T.with_width(df).collect()}
    assert got[1] == (7.0, "lanes_and_highway_defaults", [3.5, 3.5], True)
    assert got[2] == (9.0, "width", [3.0, 3.0], False)
    assert got[3][:3] == (6.5, "width:lanes", [3.0, 3.5])
    assert got[4] == (8.0, "est_width", [4.0, 4.0], True)


def test_epsilon_join_is_no_cross_join(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(-5, 5, (60, 2)), rng.uniform(-5, 5, (60, 2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, ax double, ay double")
    right = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j int, bx double, by double")
    joined = joins.epsilon_join(left, right, ("ax", "ay"), ("bx", "by"), 1.0)
    assert {(r.i, r.j) for r in joined.collect()} == {(i, j) for i in range(60) for j in range(60) if math.dist(a[i], b[j]) <= 1}
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    got = graphs.components(spark.range(205).selectExpr("id as node"), edges)
    labels = {r.node: r.component for r in got.collect()}
    assert all(labels[i] == 0 for i in range(201)) and labels[203] == 203


def test_statuses(spark):
    df = spark.createDataFrame([("a", "PASS"), ("a", "WARN"), ("b", "SKIP"), ("b", "PASS"), ("c", "odd")], "m string, s string")
    got = {r.m: r.w for r in df.groupBy("m").agg(quality.worst(F.col("s")).alias("w")).collect()}
    assert got == {"a": "WARN", "b": "PASS", "c": "UNKNOWN"}
    for found, status in ((0, "FAIL"), (7, "WARN"), (8, "PASS")):
        assert one(spark, quality.coverage(F.lit(found), F.lit(10), 0.8)) == status
    assert one(spark, quality.coverage(F.lit(0), F.lit(0), 0.8)) == "SKIP"
    for related, status in ((100, "PASS"), (99, "PASS"), (98, "WARN"), (95, "WARN"), (94, "FAIL")):
        assert one(spark, quality.raster_coverage(F.lit(related), F.lit(75), F.lit(100))) == status
