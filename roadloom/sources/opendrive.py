"""Road descriptions in OpenDRIVE XML as tables keyed by map_id and road: geometry, lanes, widths, links, junctions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import polyline as P
from roadloom.sources.osm import map_id_of

_LINK = "struct<_elementType: string, _elementId: string, _contactPoint: string>"
_LANE = "array<struct<_id: int, _type: string, link: struct<predecessor: struct<_id: int>, successor: struct<_id: int>>, width: array<struct<_sOffset: double, _a: double, _b: double, _c: double, _d: double>>, speed: array<struct<_sOffset: double, _max: double, _unit: string>>>>"
ROAD = (
    f"_id string, _name string, _length double, _junction string, link struct<predecessor: {_LINK}, successor: {_LINK}>, "
    "planView struct<geometry: array<struct<_s: double, _x: double, _y: double, _hdg: double, _length: double, line: string, arc: struct<_curvature: double>, "
    "spiral: struct<_curvStart: double, _curvEnd: double>, poly3: struct<_a: double, _b: double, _c: double, _d: double>, "
    "paramPoly3: struct<_aU: double, _bU: double, _cU: double, _dU: double, _aV: double, _bV: double, _cV: double, _dV: double, _pRange: string>>>>, "
    "elevationProfile struct<elevation: array<struct<_s: double, _a: double, _b: double, _c: double, _d: double>>>, "
    "lateralProfile struct<superelevation: array<struct<_s: double, _a: double, _b: double, _c: double, _d: double>>>, "
    f"lanes struct<laneOffset: array<struct<_s: double, _a: double, _b: double, _c: double, _d: double>>, laneSection: array<struct<_s: double, left: struct<lane: {_LANE}>, center: struct<lane: {_LANE}>, right: struct<lane: {_LANE}>>>>, "
    "signals struct<signal: array<struct<_id: string, _s: double, _t: double, _type: string, _subtype: string, _country: string, _orientation: string, _value: double, _unit: string, validity: array<struct<_fromLane: int, _toLane: int>>>>>, "
    "objects struct<object: array<struct<_id: string, _type: string, _s: double, _t: double, _hdg: double, outline: struct<cornerLocal: array<struct<_u: double, _v: double, _z: double>>>>>>"
)
JUNCTION = "_id string, _name string, connection array<struct<_id: string, _incomingRoad: string, _connectingRoad: string, _linkedRoad: string, _contactPoint: string, laneLink: array<struct<_from: int, _to: int>>>>"


@dataclass
class RoadTables:
    road: DataFrame
    geometry: DataFrame
    lane: DataFrame
    width: DataFrame
    signal: DataFrame
    object: DataFrame
    junction_link: DataFrame
    profile: DataFrame


def read(spark: SparkSession, path: str) -> RoadTables:
    """All files under a path or glob."""

    def scan(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", "true").load(path).withColumn("map_id", map_id_of(F.col("_metadata.file_path")))

    r = scan("road", ROAD).withColumnRenamed("_id", "road_id")
    road = r.select("map_id", "road_id", F.col("_name").alias("name"), F.col("_length").alias("length"), F.nullif("_junction", F.lit("-1")).alias("junction"), *[F.col(f"link.{side}.{a}").alias(f"{short}_{b}") for side, short in (("predecessor", "pred"), ("successor", "succ")) for a, b in (("_elementType", "type"), ("_elementId", "id"), ("_contactPoint", "contact"))])
    g = r.select("map_id", "road_id", F.posexplode("planView.geometry").alias("pos", "g"))
    kind = F.when(F.col("g.arc").isNotNull(), "arc").when(F.col("g.spiral").isNotNull(), "spiral").when(F.col("g.poly3").isNotNull(), "poly3").when(F.col("g.paramPoly3").isNotNull(), "paramPoly3").otherwise("line")
    geometry = g.select("map_id", "road_id", "pos", F.col("g._s").alias("s"), F.col("g._x").alias("x"), F.col("g._y").alias("y"), F.col("g._hdg").alias("hdg"), F.col("g._length").alias("length"), kind.alias("kind"), F.coalesce("g.arc._curvature", "g.spiral._curvStart").alias("curvature"), F.col("g.spiral._curvEnd").alias("curvature_end"), F.col("g.poly3").alias("poly3"), F.col("g.paramPoly3").alias("param_poly3"))
    section = r.select("map_id", "road_id", F.col("_length").alias("road_length"), F.posexplode("lanes.laneSection").alias("section", "ls"))
    sides = F.explode(F.flatten(F.array_compact(F.array("ls.left.lane", "ls.center.lane", "ls.right.lane"))))
    lane = section.select("map_id", "road_id", "section", F.col("ls._s").alias("s"), "road_length", sides.alias("l"))
    lane = lane.select("map_id", "road_id", "section", "s", "road_length", F.col("l._id").alias("lane_id"), F.col("l._type").alias("type"), F.col("l.link.predecessor._id").alias("pred_lane"), F.col("l.link.successor._id").alias("succ_lane"), F.col("l.width").alias("widths"))
    width = lane.select("map_id", "road_id", "section", "lane_id", F.posexplode("widths").alias("pos", "w")).select("map_id", "road_id", "section", "lane_id", "pos", *[F.col(f"w._{c}").alias(n) for c, n in (("sOffset", "s_offset"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"))])
    s = r.select("map_id", "road_id", F.explode("signals.signal").alias("x"))
    signal = s.select("map_id", "road_id", *[F.col(f"x._{c}").alias(n) for c, n in (("id", "signal_id"), ("s", "s"), ("t", "t"), ("type", "type"), ("subtype", "subtype"), ("country", "country"), ("orientation", "orientation"), ("value", "value"), ("unit", "unit"))], F.col("x.validity").alias("validity"))
    o = r.select("map_id", "road_id", F.explode("objects.object").alias("x"))
    object_ = o.select("map_id", "road_id", F.col("x._id").alias("object_id"), F.col("x._type").alias("type"), F.col("x._s").alias("s"), F.col("x._t").alias("t"), F.col("x._hdg").alias("hdg"), F.col("x.outline.cornerLocal").alias("corners"))
    c = scan("junction", JUNCTION).select("map_id", F.col("_id").alias("junction_id"), F.explode("connection").alias("c"))
    # a direct junction names the linked road instead of a connecting one
    link = c.select("map_id", "junction_id", F.col("c._incomingRoad").alias("incoming"), F.coalesce("c._connectingRoad", "c._linkedRoad").alias("connecting"), F.col("c._contactPoint").alias("contact"), F.explode("c.laneLink").alias("ll"))
    link = link.select("map_id", "junction_id", "incoming", "connecting", "contact", F.col("ll._from").alias("from_lane"), F.col("ll._to").alias("to_lane"))
    # records of a road along s, cubic in the distance from their start
    profile = None
    for kind, records in (("lane_offset", "lanes.laneOffset"), ("elevation", "elevationProfile.elevation"), ("superelevation", "lateralProfile.superelevation")):
        one = r.select("map_id", "road_id", F.lit(kind).alias("kind"), F.posexplode(records).alias("pos", "p")).select("map_id", "road_id", "kind", "pos", *[F.col(f"p._{c}").alias(c) for c in "sabcd"])
        profile = one if profile is None else profile.unionAll(one)
    return RoadTables(road, geometry, lane.drop("widths"), width, signal, object_, link, profile)


def numbered(ids: DataFrame, by: str = "map_id", column: str = "road_id") -> DataFrame:
    """(map_id, id, number): textual ids as numbers from 1 in their order within a map; what refers to them joins this table."""
    return ids.select(by, F.col(column).alias("id")).distinct().withColumn("number", F.dense_rank().over(Window.partitionBy(by).orderBy("id")))


def lane_id(t: RoadTables) -> DataFrame:
    """Lanes with the key road|section|lane; the centre lane has none."""
    return t.lane.where("lane_id <> 0").withColumn("key", F.concat_ws("|", "road_id", F.col("section").cast("string"), F.col("lane_id").cast("string")))


def lane_edges(t: RoadTables, left_hand: bool = False) -> DataFrame:
    """(map_id, src, dst) of lane keys: links to the next and previous section, to linked roads, and junction lane links.

    A link to a road meets its first section, or its last where the contact point is not "start"; roads linked to a junction are joined
    by its connections only. An incoming road meets a junction by the end that names it; where neither does, by its last section if
    the contact point is "start" and the lane runs along the road, else by its first. Edges of lanes with a positive id are turned round, junction
    links where the connecting lane runs against the contact (all the other way with left-hand traffic).
    """
    lanes = lane_id(t)
    key = lambda road, section, lane: F.concat_ws("|", road, section.cast("string"), lane.cast("string"))
    ends = t.lane.groupBy("map_id", "road_id").agg(F.max("section").alias("last"))
    lanes = lanes.join(ends, ["map_id", "road_id"]).select("map_id", "road_id", "section", "last", "lane_id", "key", "pred_lane", "succ_lane")
    against = F.col("lane_id") > 0

    def linked(side: str) -> tuple[DataFrame, DataFrame]:
        """Pairs (lane, neighbour) within the road and across to the linked road."""
        lane, step, edge = F.col(f"{side}_lane"), (1 if side == "succ" else -1), (F.col("last") if side == "succ" else F.lit(0))
        own = lanes.where(lane.isNotNull())
        inner = own.where(F.col("section") != edge).select("map_id", against.alias("back"), F.col("key").alias("a"), key(F.col("road_id"), F.col("section") + step, lane).alias("b"))
        road = t.road.where(F.col(f"{side}_id").isNotNull() & (F.coalesce(f"{side}_type", F.lit("road")) != "junction")).select("map_id", "road_id", F.col(f"{side}_id").alias("other"), F.col(f"{side}_contact").alias("contact"))
        far = ends.toDF("map_id", "other", "other_last")
        outer = own.where(F.col("section") == edge).join(road, ["map_id", "road_id"]).join(far, ["map_id", "other"])
        section = F.when(F.col("contact") == "start", F.lit(0)).otherwise(F.col("other_last"))
        return inner, outer.select("map_id", against.alias("back"), F.col("key").alias("a"), key(F.col("other"), section, lane).alias("b"))

    turned = lambda df: df.select("map_id", "back", F.col("b").alias("a"), F.col("a").alias("b"))
    edges = None
    for pairs in (*linked("succ"), *map(turned, linked("pred"))):
        edges = pairs if edges is None else edges.unionAll(pairs)
    j = t.junction_link.join(ends.toDF("map_id", "incoming", "in_last"), ["map_id", "incoming"]).join(ends.toDF("map_id", "connecting", "c_last"), ["map_id", "connecting"])
    j = j.join(t.road.select("map_id", F.col("road_id").alias("incoming"), *[f"{side}_{x}" for side in ("succ", "pred") for x in ("type", "id")]), ["map_id", "incoming"], "left")
    names = lambda side: F.coalesce((F.col(f"{side}_type") == "junction") & (F.col(f"{side}_id") == F.col("junction_id")), F.lit(False))
    at_start = F.coalesce(F.col("contact") == "start", F.lit(False))
    section = F.when(names("succ"), F.col("in_last")).when(names("pred"), F.lit(0)).when(at_start & (F.col("from_lane") < 0), F.col("in_last")).otherwise(F.lit(0))
    junction = j.select("map_id", F.when(at_start, F.col("to_lane") > 0).otherwise(F.col("to_lane") < 0).alias("back"), key(F.col("incoming"), section, F.col("from_lane")).alias("a"), key(F.col("connecting"), F.when(at_start, F.lit(0)).otherwise(F.col("c_last")), F.col("to_lane")).alias("b"))
    back = F.col("back") != F.lit(left_hand)
    return edges.unionAll(junction).select("map_id", F.when(back, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("dst")).distinct()


def lane_borders(t: RoadTables, step: float = 0.5) -> DataFrame:
    """(map_id, road_id, section, lane_id, s, inner, outer, x_inner, y_inner, x_outer, y_outer): borders of lanes at stations of a grid.

    A section has max(3, ceil(length / step)) stations from its start to its end. inner and outer are distances to the left of the reference
    line: the lane offset there, plus the widths of the lanes between. Places are for lines and arcs; other geometry has null ones.
    """
    by = Window.partitionBy("map_id", "road_id").orderBy("section")
    section = t.lane.select("map_id", "road_id", "section", "s", "road_length").distinct().withColumn("end", F.coalesce(F.lead("s").over(by), F.col("road_length")))
    n = F.greatest(F.lit(3), F.ceil((F.col("end") - F.col("s")) / step).cast("int"))
    grid = section.where("end > s").withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    grid = grid.select("map_id", "road_id", "section", F.col("s").alias("start"), "k", (F.col("s") + (F.col("end") - F.col("s")) * F.col("k") / (F.col("n") - 1)).alias("s"))
    station = ["map_id", "road_id", "section", "k"]
    lanes = t.lane.where("lane_id <> 0").select("map_id", "road_id", "section", "lane_id")
    # the last record that starts at or before a station, as an aggregate over the few of its lane or road
    records = t.width.select("map_id", "road_id", "section", "lane_id", F.struct("s_offset", "a", "b", "c", "d").alias("w"))
    at = F.col("s") - F.col("start")
    active = F.max(F.when(F.col("w.s_offset") <= at + 1e-9, F.col("w")))
    held = grid.join(lanes, ["map_id", "road_id", "section"]).join(records, ["map_id", "road_id", "section", "lane_id"], "left").groupBy(*station, "lane_id", "start", "s").agg(active.alias("w"))
    width = F.greatest(F.coalesce(P.cubic(at - F.col("w.s_offset"), *(F.col(f"w.{c}") for c in "abcd")), F.lit(0.0)), F.lit(0.0))
    side = F.signum("lane_id").cast("int")
    outward = Window.partitionBy(*station, "side").orderBy(F.abs("lane_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = held.withColumn("side", side).withColumn("width", width).withColumn("out", F.sum("width").over(outward))
    offsets = t.profile.where("kind = 'lane_offset'").select("map_id", "road_id", F.struct("s", "a", "b", "c", "d").alias("o"))
    o = grid.join(offsets, ["map_id", "road_id"], "left").groupBy(*station).agg(F.max(F.when(F.col("o.s") <= F.col("s") + 1e-9, F.col("o"))).alias("o"), F.first("s").alias("at"))
    o = o.select(*station, F.coalesce(P.cubic(F.col("at") - F.col("o.s"), *(F.col(f"o.{c}") for c in "abcd")), F.lit(0.0)).alias("offset"))
    g = t.geometry.select("map_id", "road_id", F.struct("s", "x", "y", "hdg", "kind", "curvature").alias("g"))
    placed = grid.join(g, ["map_id", "road_id"], "left").groupBy(*station).agg(F.max(F.when(F.col("g.s") <= F.col("s") + 1e-9, F.col("g"))).alias("g"), F.first("s").alias("at"))
    bend = F.when(F.col("g.kind") == "line", 0.0).when(F.col("g.kind") == "arc", F.col("g.curvature"))
    along = F.col("at") - F.col("g.s")
    placed = placed.select(*station, P.arc(F.col("g.x"), F.col("g.y"), F.col("g.hdg"), bend, along).alias("p"), (F.col("g.hdg") + bend * along).alias("heading"), bend.alias("bend"))
    j = wide.join(o, station).join(placed, station)
    outer = F.col("offset") + F.col("side") * F.col("out")
    inner = outer - F.col("side") * F.col("width")
    j = j.withColumn("inner", inner).withColumn("outer", outer)
    place = lambda v, c: F.when(F.col("bend").isNotNull(), F.col(f"p.{c}") + F.col(v) * (-F.sin("heading") if c == "x" else F.cos("heading")))
    return j.select("map_id", "road_id", "section", "lane_id", "s", "inner", "outer", *[place(v, c).alias(f"{c}_{v}") for v in ("inner", "outer") for c in ("x", "y")])


def statistics(t: RoadTables) -> DataFrame:
    """(map_id, what, kind, count): roads, junctions, sections, lanes by type, geometry, signals and objects of each map."""
    none = F.lit(None).cast("string")
    count = lambda df, what, kind: df.select("map_id", F.lit(what).alias("what"), kind.alias("kind"))
    rows = count(t.road, "road", F.when(F.col("junction").isNull(), "ordinary").otherwise("connecting"))
    rows = rows.unionAll(count(t.junction_link.select("map_id", "junction_id").distinct(), "junction", none)).unionAll(count(t.junction_link, "lane link", none))
    rows = rows.unionAll(count(t.lane.select("map_id", "road_id", "section").distinct(), "section", none)).unionAll(count(t.lane.where("lane_id <> 0"), "lane", F.col("type")))
    rows = rows.unionAll(count(t.geometry, "geometry", F.col("kind"))).unionAll(count(t.signal, "signal", F.col("type"))).unionAll(count(t.object, "object", F.col("type")))
    return rows.groupBy("map_id", "what", "kind").agg(F.count("*").alias("count"))


def structure_checks(t: RoadTables) -> DataFrame:
    """(map_id, check, status, found, expected): FAIL where road ids repeat, a road has no length, plan view or lanes, or a junction link names a
    road or lane that isn't there."""
    road = t.road.select("map_id", "road_id", "length")
    all_ = road.groupBy("map_id").agg(F.count("*").alias("expected"), F.countDistinct("road_id").alias("unique"), F.count_if(F.col("length") > 0).alias("long"))
    ids = road.select("map_id", "road_id").distinct()
    has = lambda df: ids.join(df.select("map_id", "road_id").distinct(), ["map_id", "road_id"], "left_semi").groupBy("map_id").agg(F.count("*").alias("found"))
    total = ids.groupBy("map_id").agg(F.count("*").alias("expected"))
    rows = all_.select("map_id", F.lit("unique road ids").alias("check"), F.col("unique").alias("found"), "expected").unionAll(all_.select("map_id", F.lit("positive length"), "long", "expected"))
    for name, df in (("plan view", t.geometry), ("lanes", t.lane.where("lane_id <> 0"))):
        rows = rows.unionAll(total.join(has(df), "map_id", "left").select("map_id", F.lit(name), F.coalesce("found", F.lit(0)), "expected"))
    lanes = t.lane.select("map_id", "road_id", "lane_id").distinct()
    link = t.junction_link.join(lanes.toDF("map_id", "incoming", "from_lane").withColumn("a", F.lit(1)), ["map_id", "incoming", "from_lane"], "left").join(lanes.toDF("map_id", "connecting", "to_lane").withColumn("b", F.lit(1)), ["map_id", "connecting", "to_lane"], "left")
    links = link.groupBy("map_id").agg(F.count(F.col("a") + F.col("b")).alias("found"), F.count("*").alias("expected")).select("map_id", F.lit("junction lane links"), "found", "expected")
    return rows.unionAll(links).withColumn("status", F.when(F.col("found") < F.col("expected"), "FAIL").otherwise("PASS"))
