"""XML maps are read, written and read again."""

import glob

from pyspark.sql import functions as F

from roadloom.sources import opendrive, osm, writers
from roadloom.streaming import ingest

MAP = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="48.0" lon="11.0"><tag k="local_x" v="0"/><tag k="local_y" v="0"/></node>
<node id="2" lat="48.0" lon="11.1"><tag k="local_x" v="10"/><tag k="local_y" v="0"/></node>
<node id="3" lat="" lon=""><tag k="local_x" v="0"/><tag k="local_y" v="3"/></node>
<node id="-4" lat="48" lon="11"><tag k="local_x" v="10"/><tag k="local_y" v="3"/></node>
<node id="5" lat="nan" lon="11"/>
<way id="11"><nd ref="1"/><nd ref="2"/></way>
<way id="12"><nd ref="3"/><nd ref="-4"/><tag k="highway" v="primary"/><tag k="name" v="a &amp; &quot;b&quot;"/></way>
<way id="13"><nd ref="3"/><nd ref="99"/><tag k="highway" v="footway"/></way>
<relation id="21"><member type="way" ref="12" role="left"/><member type="way" ref="11" role="right"/><member type="way" ref="11" role="left"/><tag k="type" v="lanelet"/></relation>
<relation id="22"><member type="way" ref="12" role="left"/><tag k="type" v="lanelet"/></relation>
<relation id="23" action="delete"><tag k="type" v="lanelet"/></relation>
<relation id="24"><member type="way" ref="12" role="from"/><member type="node" ref="-4" role="via"/><member type="way" ref="13" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_left_turn"/></relation>
<relation id="25"><member type="way" ref="12" role="from"/><tag k="type" v="restriction"/></relation>
<relation id="26"><member type="way" ref="11" role="refers"/><member type="way" ref="12" role="ref_line"/><tag k="type" v="regulatory_element"/><tag k="subtype" v="traffic_light"/></relation>
</osm>"""

ROADS = """<?xml version="1.0"?><OpenDRIVE><header revMajor="1"/>
<road id="r1" length="100" junction="-1"><link><successor elementType="road" elementId="r2" contactPoint="start"/></link>
<planView><geometry s="0" x="0" y="0" hdg="0" length="60"><line/></geometry><geometry s="60" x="60" y="0" hdg="0" length="40"><arc curvature="0.01"/></geometry></planView>
<lanes><laneSection s="0"><left><lane id="1" type="driving"><link><successor id="1"/></link><width sOffset="0" a="3.5" b="0" c="0" d="0"/></lane></left>
<center><lane id="0" type="none"/></center><right><lane id="-1" type="driving"><link><successor id="-1"/></link><width sOffset="0" a="3" b="0" c="0" d="0"/><width sOffset="5" a="4" b="0" c="0" d="0"/></lane></right></laneSection>
<laneSection s="50"><center><lane id="0" type="none"/></center><right><lane id="-1" type="driving"><link><successor id="-2"/></link></lane></right></laneSection></lanes>
<signals><signal id="s1" s="10" t="2" type="274" value="50" unit="km/h"><validity fromLane="-1" toLane="-1"/></signal></signals></road>
<road id="r2" length="50" junction="-1"><planView><geometry s="0" x="100" y="0" hdg="0" length="50"><line/></geometry></planView>
<lanes><laneSection s="0"><center><lane id="0" type="none"/></center><right><lane id="-1" type="driving"/><lane id="-2" type="driving"/></right></laneSection></lanes></road>
<junction id="j1"><connection id="0" incomingRoad="r1" connectingRoad="r2" contactPoint="start"><laneLink from="-1" to="-1"/></connection></junction></OpenDRIVE>"""


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_map_tables(spark, tmp_path):
    m = osm.read(spark, put(tmp_path, "a.osm", MAP))
    assert {r.node_id for r in m.node.collect()} == {"1", "2", "3", "-4"}
    lanelets = {r.lanelet_id: r for r in osm.lanelets(m).collect()}
    assert set(lanelets) == {"21", "22"}
    assert (lanelets["21"].left_way, lanelets["21"].right_way, lanelets["21"].skipped) == ("12", "11", None)
    assert lanelets["22"].skipped == "no right boundary"
    assert {(r.x, r.y, r["mode"]) for r in osm.coordinates(m).collect()} == {(0, 0, "local"), (10, 0, "local"), (0, 3, "local"), (10, 3, "local")}
    assert [r.node_id for r in osm.missing_nodes(m).collect()] == ["99"]
    assert [r.way_id for r in osm.roads(m).collect()] == ["12"]
    assert [r.way_id for r in osm.roads(m, osm.SUB_LAYER).collect()] == ["13"]
    assert [(r.rule, r.from_way, r.via_type, r.via, r.to_way) for r in osm.restrictions(m).collect()] == [("no_left_turn", "12", "node", "-4", "13")]
    assert {(r.role, r.ref, r.subtype) for r in osm.regulatory(m).collect()} == {("refers", "11", "traffic_light"), ("ref_line", "12", "traffic_light")}


def test_written_map_reads_the_same(spark, tmp_path):
    m = osm.read(spark, put(tmp_path, "a.osm", MAP))
    writers.write_osm(m, str(tmp_path / "out"))
    (file,) = glob.glob(str(tmp_path / "out/map_id=a/*.txt"))
    text = open(file, encoding="utf-8").read()
    assert text.index('<node id="-4"') < text.index('<node id="1"') < text.index("<way") < text.index("<relation")
    again = osm.read(spark, file)
    for table in ("node", "way", "way_node", "relation", "member"):
        key = lambda df: sorted(repr(r) for r in df.drop("map_id").collect())
        assert key(getattr(m, table)) == key(getattr(again, table)), table


def test_long_tags(spark):
    value = "é" * 300
    df = spark.createDataFrame([(value,), ("short",)], "v string").select("v", F.map_from_entries(writers.chunked_tag(F.lit("k"), F.col("v"))).alias("tags"))
    for r in df.withColumn("again", writers.joined_tag(F.col("tags"), "k")).collect():
        assert r.again == r.v and all(len(x.encode()) <= 255 for x in r.tags.values())
    part = df.where("v <> 'short'").select(F.map_filter("tags", lambda k, _: k != "k:1").alias("tags")).select(writers.joined_tag(F.col("tags"), "k").alias("again")).first()
    assert part.again is None


def test_road_tables(spark, tmp_path):
    t = opendrive.read(spark, put(tmp_path, "b.xodr", ROADS))
    assert {(r.road_id, r.length, r.junction, r.succ_id) for r in t.road.collect()} == {("r1", 100.0, None, "r2"), ("r2", 50.0, None, None)}
    assert [(r.kind, r.curvature) for r in t.geometry.where("road_id = 'r1'").orderBy("pos").collect()] == [("line", None), ("arc", 0.01)]
    assert t.width.count() == 3 and t.signal.first().validity[0]["_fromLane"] == -1
    assert {(r.id, r.number) for r in opendrive.numbered(t.road).collect()} == {("r1", 1), ("r2", 2)}
    assert {(r.src, r.dst) for r in opendrive.lane_edges(t).collect()} == {("r1|0|-1", "r1|1|-1"), ("r1|1|1", "r1|0|1"), ("r1|1|-1", "r2|0|-2"), ("r1|1|-1", "r2|0|-1")}


JOINED = """<?xml version="1.0"?><OpenDRIVE>
<road id="a" length="9" junction="-1"><link><predecessor elementType="junction" elementId="J"/></link><lanes><laneSection s="0"><right><lane id="-1" type="driving"/></right><left><lane id="2" type="driving"/></left></laneSection><laneSection s="5"><right><lane id="-1" type="driving"><link><predecessor id="-1"/></link></lane></right></laneSection></lanes></road>
<road id="b" length="9" junction="J"><link><predecessor elementType="road" elementId="a" contactPoint="end"/></link><lanes><laneSection s="0"><right><lane id="-1" type="driving"><link><predecessor id="-1"/></link></lane></right></laneSection></lanes></road>
<road id="c" length="9" junction="J"><lanes><laneSection s="0"><left><lane id="1" type="driving"/></left></laneSection><laneSection s="5"><left><lane id="1" type="driving"/></left></laneSection></lanes></road>
<junction id="J"><connection id="0" incomingRoad="a" connectingRoad="b" contactPoint="start"><laneLink from="2" to="-1"/></connection><connection id="1" incomingRoad="a" connectingRoad="c" contactPoint="end"><laneLink from="2" to="1"/></connection></junction></OpenDRIVE>"""


def test_lane_edges_by_contact(spark, tmp_path):
    """Predecessor links, an incoming road that meets the junction by its start, and connecting roads met by their end."""
    t = opendrive.read(spark, put(tmp_path, "j.xodr", JOINED))
    want = {("a|0|-1", "a|1|-1"), ("a|1|-1", "b|0|-1"), ("a|0|2", "b|0|-1"), ("a|0|2", "c|1|1")}
    assert {(r.src, r.dst) for r in opendrive.lane_edges(t).collect()} == want
    assert {(r.src, r.dst) for r in opendrive.lane_edges(t, left_hand=True).collect()} == {(b, a) for a, b in want}


def test_profiles_and_borders(spark, tmp_path):
    text = ROADS.replace('<lanes><laneSection s="0"><left>', '<elevationProfile><elevation s="0" a="5" b="0.1" c="0" d="0"/></elevationProfile><lateralProfile><superelevation s="3" a="0.01" b="0" c="0" d="0"/></lateralProfile><lanes><laneOffset s="0" a="0" b="0" c="0" d="0"/><laneOffset s="10" a="1" b="0" c="0" d="0"/><laneSection s="0"><left>')
    t = opendrive.read(spark, put(tmp_path, "p.xodr", text))
    assert {(r.road_id, r.kind, r.s, r.a, r.b) for r in t.profile.collect()} == {("r1", "lane_offset", 0, 0, 0), ("r1", "lane_offset", 10, 1, 0), ("r1", "elevation", 0, 5, 0.1), ("r1", "superelevation", 3, 0.01, 0)}
    rows = opendrive.lane_borders(t, 5.0).where("road_id = 'r1' and section = 0").collect()
    got = {(r.lane_id, round(r.s, 6)): r for r in rows}
    stations = sorted({s for _, s in got})
    assert len(stations) == 10 and stations[0] == 0 and stations[-1] == 50
    first, late = got[-1, 0.0], got[-1, stations[-1]]
    assert (first.inner, first.outer) == (0, -3) and (first.x_outer, first.y_outer) == (0, -3)
    assert (late.inner, late.outer) == (1, -3)  # an offset of 1 from s = 10, a width of 4 from s = 5
    assert (got[1, 0.0].inner, got[1, 0.0].outer) == (0, 3.5) and got[1, stations[-1]].outer == 4.5
    assert {(r.inner, r.outer) for r in opendrive.lane_borders(t).where("road_id = 'r2' and lane_id = -2").collect()} == {(0, 0)}  # no width is 0


def test_written_roads_read_the_same(spark, tmp_path):
    line = [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 5.0)]
    roads = spark.createDataFrame(
        [("m", "a", None, line, [(-1, "driving", 3.5), (-2, "shoulder", 1.0), (1, "driving", 3.0)], None, None, None, "junction", "J", None), ("m", "b", "J", line[:2], [(-1, "driving", 3.0)], "road", "a", "end", None, None, None)],
        "map_id string, road_id string, junction string, line array<struct<x: double, y: double>>, lanes array<struct<id: int, type: string, width: double>>, pred_type string, pred_id string, pred_contact string, succ_type string, succ_id string, succ_contact string",
    )
    links = spark.createDataFrame([("m", "J", "a", "b", "start", -1, -1)], "map_id string, junction_id string, incoming string, connecting string, contact string, from_lane int, to_lane int")
    writers.write_opendrive(roads, links, str(tmp_path / "out"))
    (file,) = glob.glob(str(tmp_path / "out/map_id=m/*.txt"))
    t = opendrive.read(spark, file)
    assert {(r.road_id, r.length, r.junction, r.pred_id, r.pred_contact, r.succ_type) for r in t.road.collect()} == {("a", 15.0, None, None, None, "junction"), ("b", 10.0, "J", "a", "end", None)}
    assert [(r.s, r.x, r.y, round(r.hdg, 6), r.length) for r in t.geometry.where("road_id = 'a'").orderBy("pos").collect()] == [(0, 0, 0, 0, 10), (10, 10, 0, 1.570796, 5)]
    assert {(r.road_id, r.lane_id, r.a) for r in t.width.collect()} == {("a", -1, 3.5), ("a", -2, 1.0), ("a", 1, 3.0), ("b", -1, 3.0)}
    assert {(r.src, r.dst) for r in opendrive.lane_edges(t).collect()} == {("a|0|-1", "b|0|-1")}
    text = open(file, encoding="utf-8").read()
    assert text.index("<link>") < text.index("<planView>") < text.index("<lanes>") < text.index("<junction ")


def test_degrees_become_metres(spark, tmp_path):
    """A map without local coordinates is projected to the zone of its mean longitude; a degree of latitude is some 111 km."""
    text = """<?xml version="1.0"?><osm><node id="1" lat="48.0" lon="11.0"/><node id="2" lat="48.001" lon="11.0"/><node id="3" lat="-0.001" lon="9.0"/><way id="7"><nd ref="1"/><nd ref="2"/></way></osm>"""
    got = {r.node_id: r for r in osm.coordinates(osm.read(spark, put(tmp_path, "g.osm", text))).collect()}
    assert got["1"]["mode"] == "utm_epsg_32632" and abs(got["1"].x - 649224) < 5000 and abs(got["1"].y - 5318000) < 5000
    assert abs(((got["2"].x - got["1"].x) ** 2 + (got["2"].y - got["1"].y) ** 2) ** 0.5 - 111.2) < 0.3
    assert abs(got["3"].y + 110.5) < 1 and abs(got["3"].x - 500000) < 1  # one northing for the whole map
    south = text.replace("48.0", "-33.0").replace("-33.001", "-33.001")
    assert {r["mode"] for r in osm.coordinates(osm.read(spark, put(tmp_path, "s.osm", south))).collect()} == {"utm_epsg_32732"}


def test_statistics_and_structure(spark, tmp_path):
    t = opendrive.read(spark, put(tmp_path, "j.xodr", JOINED))
    counts = {(r.what, r.kind): r["count"] for r in opendrive.statistics(t).collect()}
    assert counts["road", "ordinary"] == 1 and counts["road", "connecting"] == 2 and counts["lane", "driving"] == 6 and counts["lane link", None] == 2 and counts["section", None] == 5
    checks = {r.check: (r.status, r.found, r.expected) for r in opendrive.structure_checks(t).collect()}
    assert checks == {"unique road ids": ("PASS", 3, 3), "positive length": ("PASS", 3, 3), "plan view": ("FAIL", 0, 3), "lanes": ("PASS", 3, 3), "junction lane links": ("PASS", 2, 2)}
    broken = opendrive.read(spark, put(tmp_path, "k.xodr", JOINED.replace('from="2" to="1"', 'from="7" to="1"').replace('id="c" length="9"', 'id="a" length="0"')))
    checks = {r.check: (r.status, r.found) for r in opendrive.structure_checks(broken).collect()}
    assert checks["unique road ids"] == ("FAIL", 2) and checks["positive length"] == ("FAIL", 2) and checks["junction lane links"] == ("FAIL", 1)


def test_folder_stream_records_a_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.osm", MAP)
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    ingest.watch(spark, *args).awaitTermination()
    put(tmp_path / "in", "c.osm", MAP)
    ingest.watch(spark, *args).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.map_id for r in rows) == ["a", "c"] and len({r.document for r in rows}) == 1
