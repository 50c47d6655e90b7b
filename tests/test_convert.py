"""Lane maps from road descriptions and road networks, and back, through files."""

import glob

import pytest

from roadloom import api, convert
from roadloom.sources import opendrive, osm, writers

XODR = """<?xml version="1.0"?><OpenDRIVE>
<road id="main" length="20" junction="-1"><planView><geometry s="0" x="100" y="50" hdg="0" length="20"><line/></geometry></planView><lanes>
<laneSection s="0"><left><lane id="1" type="driving"><link><successor id="1"/></link><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></left><right><lane id="-1" type="driving"><link><successor id="-1"/></link><width sOffset="0" a="4" b="0" c="0" d="0"/></lane>
<lane id="-2" type="driving"><link><successor id="-2"/></link><width sOffset="0" a="3" b="0" c="0" d="0"/></lane><lane id="-3" type="sidewalk"><width sOffset="0" a="2" b="0" c="0" d="0"/></lane></right></laneSection>
<laneSection s="12"><left><lane id="1" type="driving"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></left><right><lane id="-1" type="driving"><width sOffset="0" a="4" b="0" c="0" d="0"/></lane><lane id="-2" type="driving"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></right></laneSection>
</lanes></road></OpenDRIVE>"""


def tagged(m, key):
    return {r.rel_id: r.tags[key] for r in m.relation.collect()}


def saved(spark, m, folder):
    writers.write_osm(m, str(folder))
    return osm.read(spark, glob.glob(str(folder / "map_id=*/*.txt"))[0])


def test_lanes_of_roads(spark, tmp_path):
    (tmp_path / "r.xodr").write_text(XODR)
    m = saved(spark, convert.from_roads(opendrive.read(spark, str(tmp_path / "r.xodr"))), tmp_path / "out")
    name = tagged(m, "source:opendrive:lane")
    assert sorted(name.values()) == [f"main|{s}|{k}" for s in (0, 1) for k in (-1, -2, 1)]
    lanes = {name[r.lanelet_id]: r for r in api.lane_geometry(m).collect()}
    assert lanes["main|0|-1"].width == pytest.approx(4) and lanes["main|0|1"].width == pytest.approx(3)
    assert [tuple(p) for p in lanes["main|0|-2"].left][::23] == [(100, 46), (112, 46)]
    assert lanes["main|0|-1"].direction == 1 and lanes["main|0|1"].direction == 16  # along the road and against it
    assert lanes["main|0|-1"].right_way == lanes["main|0|-2"].left_way  # a border is one way
    edges = {(name[r.src], name[r.dst], r.role) for r in api.lane_topology(m).collect()}
    assert {("main|0|-1", "main|1|-1", "successor"), ("main|0|-2", "main|1|-2", "successor"), ("main|1|1", "main|0|1", "successor")} <= edges
    assert {e for e in edges if e[2] == "right"} == {("main|0|-1", "main|0|-2", "right"), ("main|1|-1", "main|1|-2", "right")}
    assert sum(1 for e in edges if e[2] == "successor") == 3


NETWORK = """<?xml version="1.0"?><osm>""" + "".join(f'<node id="{i}" lat="48" lon="11"><tag k="local_x" v="{x}"/><tag k="local_y" v="{y}"/></node>' for i, (x, y) in enumerate([(0, 0), (40, 0), (40, 30)])) + """
<way id="5"><nd ref="0"/><nd ref="1"/><tag k="highway" v="primary"/><tag k="lanes" v="3"/><tag k="lanes:forward" v="2"/><tag k="lanes:backward" v="1"/><tag k="turn:lanes:forward" v="left|through;right"/><tag k="maxspeed" v="36"/></way>
<way id="6"><nd ref="1"/><nd ref="2"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/><tag k="lanes" v="1"/></way></osm>"""


def test_lanes_of_ways(spark, tmp_path):
    (tmp_path / "n.osm").write_text(NETWORK)
    m = saved(spark, convert.from_ways(osm.read(spark, str(tmp_path / "n.osm"))), tmp_path / "out")
    tags = {r.rel_id: r.tags for r in m.relation.collect()}
    lanes = {r.lanelet_id: r for r in api.lane_geometry(m).collect()}
    assert len(tags) == 4 and {t["source:osm:way"] for t in tags.values()} == {"5", "6"}
    five = sorted((t["direction"], t.get("turn"), lanes[i].direction, round(lanes[i].center[0].y, 3)) for i, t in tags.items() if t["source:osm:way"] == "5")
    width = lanes[next(iter(lanes))].width
    assert five == [("backward", None, 16, pytest.approx(width)), ("forward", "left", 1, 0), ("forward", "through;right", 1, pytest.approx(-width))]
    assert all(t["speed_limit"] == "10.00" for t in tags.values() if t["source:osm:way"] == "5")
    (six,) = [i for i, t in tags.items() if t["source:osm:way"] == "6"]
    assert lanes[six].direction == 4 and {tuple(p) for p in lanes[six].center} >= {(40, 0), (40, 30)}


def test_lanes_become_roads(spark, tmp_path):
    (tmp_path / "r.xodr").write_text(XODR)
    m = convert.from_roads(opendrive.read(spark, str(tmp_path / "r.xodr")))
    roads, connections = convert.to_roads(m)
    writers.write_opendrive(roads, connections, str(tmp_path / "back"))
    t = opendrive.read(spark, glob.glob(str(tmp_path / "back/map_id=r/*.txt"))[0])
    name = tagged(m, "source:opendrive:lane")
    assert {name[r.road_id]: round(r.length, 6) for r in t.road.collect()} == {f"main|{s}|{k}": 12 if s == 0 else 8 for s in (0, 1) for k in (-1, -2, 1)}
    links = {(name[r.src.split("|")[0]], name[r.dst.split("|")[0]]) for r in opendrive.lane_edges(t).collect()}
    assert links == set()  # roads are linked; lanes of one-lane roads have no lane links of their own
    assert {(name[r.road_id], name[r.succ_id]) for r in t.road.where("succ_id is not null").collect()} == {("main|0|-1", "main|1|-1"), ("main|0|-2", "main|1|-2"), ("main|1|1", "main|0|1")}
    back = convert.from_roads(t)
    widths = {round(r.width, 3) for r in api.lane_geometry(back).collect()}
    assert widths == {3, 4}


def test_maps_without_roads(spark, tmp_path):
    (tmp_path / "n.osm").write_text(NETWORK.replace("highway", "railway"))
    m = convert.from_ways(osm.read(spark, str(tmp_path / "n.osm")))
    assert m.relation.count() == m.way.count() == m.node.count() == 0
