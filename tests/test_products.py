"""Repairs, sign texts, lane links, round trips and raster products on small fixtures."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import frames, signs
from roadloom.operators import joins, lanes, products, roundtrip
from roadloom.sources import repairs


def test_sign_texts(spark):
    texts = {"DE:274-50": [("limit", 50 / 3.6)], "DE:274.1[30]": [("zone", 30.0)], "DE:274:x,260": [("260", None)], "DE:y_limit;DE:206": [("town", None), ("206", None)], "DE:252[3.5]": [("252", 3.5)]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", signs.elements(F.col("t")).alias("e")).collect()
    for r in rows:
        assert [(e.sign, pytest.approx(e.value) if e.value is not None else None) for e in r.e] == texts[r.t], r.t


def test_bans_turn_to_a_side(spark):
    rows = spark.createDataFrame([(["no_straight_on"], "left"), (["no_right_turn", "no_straight_on"], "right"), (None, "left"), (["no_u_turn"], "left")], "r array<string>, side string")
    got = [tuple(r.b) for r in rows.select(signs.turn_bans(signs.turned_bans(F.col("r"), F.col("side"))).alias("b")).collect()]
    assert got == [(True, False, False), (False, False, True), (False, False, False), (False, False, False)]


def test_osm_repairs(spark):
    rows = [("a", None, {"highway": "stop"}), ("b", "3", {"highway": "give_way", "traffic_sign": "DE:260"}), ("c", "1", {"traffic_sign": "unknown"}), ("d", "1", {"highway": "stop", "traffic_sign": "DE:206"}), ("e", "1", None), ("f", "1", {"traffic_sign": "DE:274.2,260", "x": "y"})]
    got = {r.id: (r.version, r.tags, r.repairs) for r in repairs.osm_repairs(spark.createDataFrame([("m", *r) for r in rows], "map_id string, id string, version string, tags map<string,string>")).collect()}
    assert got["a"] == ("1", {"highway": "stop", "traffic_sign": "DE:206"}, ["version", "priority_sign"])
    assert got["b"][1]["traffic_sign"] == "DE:260;DE:205" and got["b"][2] == ["priority_sign"]
    assert got["c"] == ("1", {}, ["traffic_sign"]) and got["f"] == ("1", {"x": "y"}, ["traffic_sign"])
    assert got["d"][2] == [] and got["d"][1] == {"highway": "stop", "traffic_sign": "DE:206"} and got["e"] == ("1", None, [])


def test_ids_become_free_numbers(spark):
    rows = [("m", "road", i) for i in ("1", "3", "main", "side", "-7")] + [("m", "junction", "j"), ("m", "junction", "2"), ("n", "road", "x")]
    got = {(r.map_id, r.kind, r.id): r.number for r in repairs.integer_ids(spark.createDataFrame(rows, "map_id string, kind string, id string")).collect()}
    assert got == {("m", "road", "main"): 4, ("m", "road", "side"): 5, ("m", "junction", "j"): 6, ("n", "road", "x"): 1}


def test_direct_junctions_name_the_linked_road(spark):
    rows = spark.createDataFrame([("direct", None, "5"), ("direct", "4", "5"), ("default", None, "5")], "k string, c string, l string")
    assert [r.x for r in rows.select(repairs.direct_connection(F.col("k"), F.col("c"), F.col("l")).alias("x")).collect()] == ["5", "4", None]


def test_images_hold_the_cells(spark):
    cells = spark.createDataFrame([("a", 10, 5, 1, 700), ("a", 12, 9, 4, 0), ("a", 11, 5, 0, 65535), ("b", 0, 0, 9, 9)], "map_id string, row long, col long, drivable int, lane_index int")
    got = {r.map_id: r for r in products.images(cells, ["drivable", "lane_index"]).collect()}
    a = got["a"]
    assert (a.row0, a.col0, a.width, a.height) == (10, 5, 5, 3)
    data = bytes(a.image)
    assert data[:4] == b"II*\0"
    (n,) = struct.unpack_from("<H", data, 8)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from("<HHI", data, 10 + 12 * k)
        form = "<" + ("H" if kind == 3 else "I") * count
        size = struct.calcsize(form)
        at = 18 + 12 * k if size <= 4 else struct.unpack_from("<I", data, 18 + 12 * k)[0]
        tags[tag] = struct.unpack_from(form, data, at)
    assert tags[256] == (5,) and tags[257] == (3,) and tags[258] == (16, 16) and tags[277] == (2,)
    bands = [np.frombuffer(zlib.decompress(data[p : p + s]), "<u2").reshape(3, 5) for p, s in zip(tags[273], tags[279], strict=True)]
    assert bands[0].tolist() == [[0, 0, 0, 0, 4], [0] * 5, [1, 0, 0, 0, 0]] and bands[1][1, 0] == 65535 and bands[1][2, 0] == 700
    with pytest.raises(Exception, match="the bound is 4"):
        products.images(cells, ["drivable"], most_pixels=4).collect()
    assert products.images(cells.limit(0), ["drivable"]).count() == 0


def test_metadata(spark):
    cells = spark.createDataFrame([("a", 1, 1, 1, 0), ("a", 1, 2, 1, 1)], "map_id string, row long, col long, drivable int, boundary int")
    frames = spark.createDataFrame([("a", "local", 0.0, 0.0, 10.0, 5.0, 3), ("b", "local", 0.0, 0.0, 1.0, 1.0, 0)], "map_id string, mode string, x0 double, y0 double, x1 double, y1 double, lanes int")
    got = {r.map_id: json.loads(r.json) for r in products.metadata(cells, frames, 0.5, 5.0).collect()}
    assert got["a"]["pixels"] == {"drivable": 2, "boundary": 1} and (got["a"]["width"], got["a"]["height"]) == (20, 10) and got["a"]["bands"]["6"] == "lane_index"
    assert got["b"]["pixels"] == {"drivable": 0, "boundary": 0}


def test_lanes_that_come_and_go(spark):
    pairs = spark.createDataFrame([("same", 2, 2, "none", "none"), ("new left", 1, 3, "none", "none"), ("new right", 1, 3, "none", "right"), ("fewer", 3, 1, "none", "none"), ("fewer right", 3, 2, "left", "none"), ("none", 0, 2, "none", "none")], "link string, incoming int, outgoing int, last_in string, last_out string")
    got = {}
    for r in lanes.linked(pairs).collect():
        got.setdefault(r.link, set()).add((r.src, r.dst))
    assert got == {"same": {(0, 0), (1, 1)}, "new left": {(0, 0), (0, 1), (0, 2)}, "new right": {(0, 0), (0, 1), (0, 2)}, "fewer": {(0, 0), (1, 0), (2, 0)}, "fewer right": {(0, 0), (1, 1), (2, 1)}}


def test_targets_in_order(spark):
    mapping = spark.createDataFrame([("s", "c"), ("s", "a"), ("s", "b"), ("t", "x"), ("u", "y"), ("u", "z"), ("v", "p"), ("v", "q"), ("v", "r")], "source string, target string")
    edges = spark.createDataFrame([("b", "c"), ("a", "b"), ("c", "y"), ("p", "q"), ("q", "p")], "src string, dst string")
    got = {r.source: (r.path, r.state) for r in roundtrip.ordered_targets(mapping, edges).collect()}
    assert got == {"s": (["a", "b", "c"], "chain"), "t": (["x"], "identity"), "u": (None, "broken"), "v": (None, "broken")}


def test_gaps_are_not_bridged(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    paths = spark.createDataFrame([("near", ["a", "b"]), ("far", ["a", "c"])], "source string, path array<string>")
    lines = spark.createDataFrame([("a", line((0, 0), (1, 0))), ("b", line((1.04, 0), (2, 0))), ("c", line((1.1, 0), (2, 0)))], "target string, line array<struct<x: double, y: double>>")
    got = {r.source: r.line for r in roundtrip.joined_lines(paths, lines).collect()}
    assert len(got["near"]) == 4 and got["far"] is None


def test_edges_go_through_generated_pieces_only(spark):
    mapping = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("D", 4)], "source string, target long")
    source = spark.createDataFrame([("A", "B", "successor"), ("A", "C", "successor"), ("A", "D", "successor"), ("B", "A", "left")], "src string, dst string, role string")
    # 1 -> 2 directly; 1 -> 90 -> 91 -> 3 through connectors; 1 -> 2 -> 4 only through another lane
    made = spark.createDataFrame([(1, 2, "successor"), (1, 90, "successor"), (90, 91, "successor"), (91, 3, "successor"), (2, 4, "successor")], "src long, dst long, role string")
    got = {(r.src, r.dst, r.role): r.how for r in roundtrip.kept_edges(source, mapping, made).collect()}
    assert got == {("A", "B", "successor"): "direct", ("A", "C", "successor"): "path", ("A", "D", "successor"): None, ("B", "A", "left"): None}


def test_frames_without_a_way_are_refused(spark):
    g, p, site = ("geographic", None, None, None), ("projected", None, 32, False), ("engineering", "site", None, None)
    rows = spark.createDataFrame([(11.0, 48.0, g, p), (1.0, 2.0, site, site), (11.0, 48.0, g, g)], f"x double, y double, a {frames.FRAME}, b {frames.FRAME}")
    got = [(r.how, r.p.x, r.p.y) for r in rows.select(frames.how(F.col("a"), F.col("b")).alias("how"), frames.transformed(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert [h for h, *_ in got] == ["project", "identity", "identity"] and got[1][1:] == (1, 2) and abs(got[0][1] - 649224) < 5000
    bad = spark.createDataFrame([(1.0, 2.0, site, p)], rows.schema)
    with pytest.raises(Exception, match="cannot be reconciled"):
        bad.select(frames.transformed(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("p")).collect()
    assert bad.select(frames.transformed(F.col("x"), F.col("y"), F.col("a"), F.col("b"), strict=False).alias("p")).first().p is None


def test_points_are_welded_in_order(spark):
    """A chain of points 4 cm apart: every other one is kept; height tells points apart, and maps do."""
    rows = [("m", k, 0.04 * k, 0.0, 0.0) for k in range(6)] + [("m", 10, 0.0, 0.0, 3.0), ("n", 11, 0.0, 0.0, None), ("n", 12, 0.049, 0.0, 0.0), ("n", 13, -0.03, 0.03, 0.0)]
    got = {(r.map_id, r.id): r.onto for r in joins.weld(spark.createDataFrame(rows, "map_id string, id long, x double, y double, z double"), 0.05).collect()}
    assert [got["m", k] for k in range(6)] == [0, 0, 2, 2, 4, 4]
    assert got["m", 10] == 10 and [got["n", k] for k in (11, 12, 13)] == [11, 11, 11]
    assert joins.weld(spark.createDataFrame([], "map_id string, id long, x double, y double, z double"), 0.05).count() == 0


def test_borders_that_coincide(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    borders = [("a", "1", "2", line((0, 0), (5, 0), (10, 0))), ("a2", "1", "2", line((0, 0.001), (5, 0), (10, 0))), ("b", "3", "4", line((0, 3), (10, 3))), ("b2", "4", "3", line((10, 3), (0, 3))), ("c", "5", "6", line((0, 6), (10, 6))), ("d", "7", "8", line((0, -3), (10, -3)))]
    made = [("low", "a", "d"), ("mid", "b", "a2"), ("top", "b2", "c")]  # top runs the other way, so b2 is its left border
    got = {(r.lane, r.side): (r.other, r.same_direction) for r in joins.coincident_adjacency(spark.createDataFrame(made, "lane string, left string, right string"), spark.createDataFrame(borders, "border string, start_node string, end_node string, line array<struct<x: double, y: double>>"), 0.01).collect()}
    assert got == {("low", "left"): ("mid", True), ("mid", "right"): ("low", True), ("mid", "left"): ("top", False), ("top", "left"): ("mid", False)}
