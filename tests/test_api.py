"""Two lanes side by side: bounds, cells, neighbours, checks."""

import pytest

from roadloom import api
from roadloom.settings import Settings, load
from roadloom.sources import osm

TWO = """<?xml version="1.0"?><osm>""" + "".join(f'<node id="{i}" lat="48" lon="11"><tag k="local_x" v="{x}"/><tag k="local_y" v="{y}"/></node>' for i, (x, y) in enumerate([(0, 0), (10, 0), (0, 3), (10, 3), (0, 6), (10, 6), (20, 0), (20, 3)])) + """
<way id="100"><nd ref="0"/><nd ref="1"/></way><way id="101"><nd ref="2"/><nd ref="3"/></way><way id="102"><nd ref="5"/><nd ref="4"/></way>
<way id="103"><nd ref="1"/><nd ref="6"/></way><way id="104"><nd ref="3"/><nd ref="7"/></way>
<way id="110"><nd ref="0"/><nd ref="1"/><tag k="highway" v="primary"/><tag k="lanes" v="3"/><tag k="oneway" v="yes"/><tag k="maxspeed" v="36"/></way>
<relation id="200"><member type="way" ref="101" role="left"/><member type="way" ref="100" role="right"/><tag k="type" v="lanelet"/></relation>
<relation id="201"><member type="way" ref="102" role="left"/><member type="way" ref="101" role="right"/><tag k="type" v="lanelet"/></relation>
<relation id="202"><member type="way" ref="104" role="left"/><member type="way" ref="103" role="right"/><tag k="type" v="lanelet"/></relation>
<relation id="203"><member type="way" ref="999" role="left"/><member type="way" ref="103" role="right"/><tag k="type" v="lanelet"/></relation></osm>"""


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("maps") / "two.osm"
    path.write_text(TWO)
    return osm.read(spark, str(path))


def test_lanes(two):
    lanes = {r.lanelet_id: r for r in api.lane_geometry(two).collect()}
    assert set(lanes) == {"200", "201", "202"}
    assert lanes["200"].width == pytest.approx(3) and lanes["200"].direction == 1
    assert [tuple(p) for p in lanes["200"].center][::19] == [(0, 1.5), (10, 1.5)]
    assert lanes["201"].direction == 16


def test_topology(two):
    edges = {(r.src, r.dst, r.role) for r in api.lane_topology(two).collect()}
    assert {("200", "201", "left"), ("201", "200", "right"), ("200", "202", "successor"), ("202", "200", "predecessor")} <= edges or {("201", "200", "right"), ("200", "201", "left")} <= edges
    assert ("200", "202", "successor") in edges and ("201", "202", "successor") not in edges


def test_cells(two):
    cells = api.rasterize(two).collect()
    assert len(cells) == (10 * 6 + 10 * 3) / 0.25
    assert {(r.row, r.col) for r in cells} >= {(10, 10), (21, 29)} and min(r.col for r in cells) == 10
    assert {r.direction for r in cells} == {1, 16}
    with pytest.raises(Exception, match="pixel cap"):
        api.rasterize(two, Settings(most_pixels=10)).collect()


def test_profiles_and_checks(two):
    r = api.road_profiles(two).first()
    assert (r.lanes, r.forward, r.backward, r.oneway, r.width_m, r.speed) == (3, 3, 0, True, 10.5, 10)
    checks = {r.check: (r.status, r.found, r.expected) for r in api.diagnose(two).collect()}
    assert checks == {"usable lanelets": ("WARN", 3, 4), "known node references": ("PASS", 12, 12)}
    assert {r.status for r in api.diagnose(two, Settings(categories=("raster",))).collect()} == {"SKIP"}


def test_turn_lanes_override_counts(spark, tmp_path):
    tags = {"1": {"lanes": "2", "lanes:forward": "1", "turn:lanes:forward": "left|through|right"}, "2": {"oneway": "yes", "lanes": "1", "turn:lanes": "left|right"}, "3": {"lanes": "2", "turn:lanes": "left|right"}}
    ways = "".join(f'<way id="{i}"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/>' + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in t.items()) + "</way>" for i, t in tags.items())
    (tmp_path / "t.osm").write_text('<?xml version="1.0"?><osm><node id="1" lat="48" lon="11"/><node id="2" lat="48" lon="11.001"/>' + ways + "</osm>")
    got = {r.way_id: (r.lanes, r.forward, r.backward, r.oneway) for r in api.road_profiles(osm.read(spark, str(tmp_path / "t.osm"))).collect()}
    assert got == {"1": (3, 3, 0, True), "2": (2, 2, 0, True), "3": (2, 1, 1, False)}


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"resolution": 1, "categories": ["raster"]}')
    assert load(str(path)) == Settings(resolution=1.0, categories=("raster",))
    for bad in ({"resolution": "1"}, {"resolution": -1.0}, {"most_pixels": 1.5}, {"warn_below": 2.0}, {"padding": float("nan")}):
        with pytest.raises((TypeError, ValueError)):
            Settings(**bad)
    path.write_text('{"odd": 1}')
    with pytest.raises(ValueError, match="odd"):
        load(str(path))
