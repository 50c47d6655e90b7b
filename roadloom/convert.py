"""Conversions between map kinds: lane maps from road descriptions and from road networks, road descriptions from lane maps.

All maps of a table are one job. A lane map is made of borders, each a way of its own that the lanes on both of its sides share;
points that are equal to the millimetre are one node. Ids are numbers from 1 in the order of the map, the road and the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom import api
from roadloom.functions import polyline as P
from roadloom.functions import tags as T
from roadloom.operators import lanes as L
from roadloom.operators.storage import written
from roadloom.sources import opendrive
from roadloom.sources.osm import MapTables


def lane_map(borders: DataFrame, lanes: DataFrame) -> MapTables:
    """A map of borders(map_id, border, line) and lanes(map_id, lane, left, right, tags), whose left and right name borders."""
    mm = lambda v: F.round(F.col(v) * 1000).cast("long")
    points = written(borders.select("map_id", "border", F.posexplode("line").alias("pos", "p")).select("map_id", "border", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y")).withColumn("mx", mm("x")).withColumn("my", mm("y")))
    # the first place of equal points stands for all
    nodes = points.groupBy("map_id", "mx", "my").agg(F.min(F.struct("border", "pos", "x", "y")).alias("f")).select("map_id", "mx", "my", F.col("f.x").alias("x"), F.col("f.y").alias("y"))
    nodes = written(L.numbered(nodes, [F.col("map_id"), F.col("mx"), F.col("my")]).withColumn("node_id", F.col("place").cast("string")))
    ways = written(L.numbered(borders.select("map_id", "border").distinct(), [F.col("map_id"), F.col("border")]).withColumn("way_id", F.col("place").cast("string")))
    rels = written(L.numbered(lanes, [F.col("map_id"), F.col("lane")]).withColumn("rel_id", F.col("place").cast("string")))
    text = lambda c: F.format_string("%.3f", F.col(c))
    node = nodes.select("map_id", "node_id", F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.col("x").alias("local_x"), F.col("y").alias("local_y"), F.lit(None).cast("double").alias("ele"), F.create_map(F.lit("local_x"), text("x"), F.lit("local_y"), text("y")).alias("tags"))
    refs = points.join(nodes.select("map_id", "mx", "my", "node_id"), ["map_id", "mx", "my"]).join(ways.select("map_id", "border", "way_id"), ["map_id", "border"]).select("map_id", "way_id", "pos", "node_id")
    way = ways.select("map_id", "way_id", F.create_map(F.lit("type"), F.lit("line_thin")).alias("tags"))
    relation = rels.select("map_id", "rel_id", F.map_concat(F.create_map(F.lit("type"), F.lit("lanelet")), F.col("tags")).alias("tags"))
    side = lambda name, pos: rels.join(ways.select("map_id", F.col("border").alias(name), "way_id"), ["map_id", name]).select("map_id", "rel_id", F.lit(pos).alias("pos"), F.lit("way").alias("type"), F.col("way_id").alias("ref"), F.lit(name).alias("role"))
    return MapTables(node, way, refs, relation, side("left", 0).unionAll(side("right", 1)))


def from_roads(t: opendrive.RoadTables, types: tuple[str, ...] = ("driving",), step: float = 0.5) -> MapTables:
    """A lane map of road descriptions: lanes of the given types that have a width somewhere.

    Lanes along the road share borders from the reference line outwards; those against it have their own, turned round, so that every
    lane's borders run as it does. Lanes name what they are made of in the tag source:opendrive:lane (road|section|lane).
    """
    b = opendrive.lane_borders(t, step).where("x_inner is not null")
    wanted = t.lane.where(F.col("type").isin(*types)).select("map_id", "road_id", "section", "lane_id")
    wide = b.join(wanted, ["map_id", "road_id", "section", "lane_id"], "left_semi")
    by = ["map_id", "road_id", "section", "lane_id"]

    def line(which: str) -> Column:
        return F.array_sort(F.collect_list(F.struct("s", F.col(f"x_{which}").alias("x"), F.col(f"y_{which}").alias("y"))))

    lines = wide.groupBy(*by).agg(line("inner").alias("i"), line("outer").alias("o"), F.max(F.abs(F.col("outer") - F.col("inner"))).alias("widest")).where("widest > 0")
    drawn = lambda c: F.transform(F.when(F.col("lane_id") > 0, F.reverse(c)).otherwise(F.col(c)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    # a border is known by the lane inside of it and its side; 0 is the reference line
    side = F.when(F.col("lane_id") > 0, "l").otherwise("r")
    key = lambda n: F.struct("road_id", "section", side.alias("side"), n.cast("int").alias("n"))
    outer = F.abs("lane_id")
    rows = written(lines.select("map_id", F.struct("road_id", "section", "lane_id").alias("lane"), key(outer - 1).alias("left"), key(outer).alias("right"), drawn("i").alias("i"), drawn("o").alias("o")))
    # neighbours that share a border draw it alike; the outer line of the inner lane is taken
    both = rows.select("map_id", F.col("right").alias("border"), F.lit(0).alias("k"), F.col("o").alias("line")).unionAll(rows.select("map_id", F.col("left").alias("border"), F.lit(1).alias("k"), F.col("i").alias("line")))
    borders = both.groupBy("map_id", "border").agg(F.min_by("line", "k").alias("line"))
    name = F.concat_ws("|", "lane.road_id", F.col("lane.section").cast("string"), F.col("lane.lane_id").cast("string"))
    lanes = rows.select("map_id", "lane", "left", "right", F.create_map(F.lit("subtype"), F.lit("road"), F.lit("source:opendrive:lane"), name).alias("tags"))
    return lane_map(borders, lanes)


def from_ways(m: MapTables) -> MapTables:
    """A lane map of a road network: each road's lanes side by side, parallel to its way, forward ones on the right.

    Borders are shared by the lanes of a direction on both sides of them; backward ones are drawn against the way. Lanes name their way in the tag source:osm:way; turns and speeds are tags, too.
    """
    roads = written(api.road_profiles(m)).join(m.way.select("map_id", "way_id", "tags"), ["map_id", "way_id"]).join(api.way_lines(m), ["map_id", "way_id"]).where(F.col("lanes") > 0)
    one = roads.select("map_id", "way_id", "line", "speed", F.col("forward").alias("forward_lanes"), F.col("backward").alias("backward_lanes"), (F.col("width_m") / F.col("lanes")).alias("lane_width"), *[v.alias(n) for v, n in zip(T.turn_lane_lists(*(F.col("tags")[f"turn:lanes{k}"] for k in ("", ":forward", ":backward")), F.col("oneway")), ("turns_forward", "turns_backward"), strict=True)])
    one = written(one.where(F.col("forward_lanes") + F.col("backward_lanes") > 0))
    n = F.col("forward_lanes") + F.col("backward_lanes")
    back = F.col("backward_lanes")
    drawn = F.concat(F.when(back > 0, F.transform(F.sequence(F.lit(0), back), lambda k: F.struct(F.lit(False).alias("forward"), k.alias("k")))).otherwise(F.expr("cast(array() as array<struct<forward: boolean, k: int>>)")), F.when(F.col("forward_lanes") > 0, F.transform(F.sequence(back, n), lambda k: F.struct(F.lit(True).alias("forward"), k.alias("k")))).otherwise(F.expr("cast(array() as array<struct<forward: boolean, k: int>>)")))
    edges = one.select("map_id", "way_id", "line", "lane_width", n.alias("n"), F.explode(drawn).alias("b")).select("*", "b.forward", "b.k")
    # P.offset moves to the left; the first border is the outermost on the left
    away = edges.select("map_id", "way_id", "forward", "k", "line", ((F.col("n") / 2 - F.col("k")) * F.col("lane_width")).alias("away"))
    moved = written(away.select("map_id", F.struct("way_id", "forward", "k").alias("border"), P.offset(F.col("line"), F.col("away")).alias("line"))).where(F.size("line") > 1)
    borders = moved.withColumn("line", F.when(F.col("border.forward"), F.col("line")).otherwise(F.reverse("line")))
    lanes = L.generated(one.select(F.struct("map_id", "way_id", "speed").alias("road"), "forward_lanes", "backward_lanes", "turns_forward", "turns_backward"), 1.0)
    # a backward lane runs the other way, so its left border is the one on the right
    left, right = F.when(F.col("forward"), F.col("place")).otherwise(F.col("place") + 1), F.when(F.col("forward"), F.col("place") + 1).otherwise(F.col("place"))
    entries = F.map_filter(F.create_map(F.lit("subtype"), F.lit("road"), F.lit("source:osm:way"), F.col("road.way_id"), F.lit("direction"), F.when(F.col("forward"), "forward").otherwise("backward"), F.lit("turn"), F.nullif("turn", F.lit("none")), F.lit("speed_limit"), F.format_string("%.2f", F.col("road.speed"))), lambda _, v: v.isNotNull())
    rows = lanes.select(F.col("road.map_id").alias("map_id"), F.struct("road.way_id", "place").alias("lane"), F.struct(F.col("road.way_id").alias("way_id"), "forward", left.alias("k")).alias("left"), F.struct(F.col("road.way_id").alias("way_id"), "forward", right.alias("k")).alias("right"), entries.alias("tags"))
    known = borders.select("map_id", F.col("border").alias("left"))
    return lane_map(borders, rows.join(known, ["map_id", "left"], "left_semi"))


def to_roads(m: MapTables) -> tuple[DataFrame, DataFrame]:
    """(roads, connections) for write_opendrive, of a lane map: each lane a road of one lane to the right of its left border, with the mean width
    at its samples; lanes that follow only one and are the only ones to do so are linked, others stay without links."""
    lanes = api.lane_geometry(m)
    after = api.lane_topology(m).where("role = 'successor'").select("map_id", "src", "dst")
    alone = lambda c: after.groupBy("map_id", c).agg(F.count("*").alias("n")).where("n = 1").select("map_id", c)
    single = after.join(alone("src"), ["map_id", "src"], "left_semi").join(alone("dst"), ["map_id", "dst"], "left_semi")
    follows = single.select("map_id", F.col("src").alias("road_id"), F.col("dst").alias("succ_id"))
    leads = single.select("map_id", F.col("dst").alias("road_id"), F.col("src").alias("pred_id"))
    none = F.lit(None).cast("string")
    lane = F.array(F.struct(F.lit(-1).alias("id"), F.lit("driving").alias("type"), F.round("width", 4).alias("width")))
    rows = lanes.select("map_id", F.col("lanelet_id").alias("road_id"), none.alias("junction"), F.col("left").alias("line"), lane.alias("lanes"))
    rows = rows.join(leads, ["map_id", "road_id"], "left").join(follows, ["map_id", "road_id"], "left")
    kind = lambda c, v: F.when(F.col(c).isNotNull(), v)
    rows = rows.select("map_id", "road_id", "junction", "line", "lanes", kind("pred_id", "road").alias("pred_type"), "pred_id", kind("pred_id", "end").alias("pred_contact"), kind("succ_id", "road").alias("succ_type"), "succ_id", kind("succ_id", "start").alias("succ_contact"))
    connections = m.relation.sparkSession.createDataFrame([], "map_id string, junction_id string, incoming string, connecting string, contact string, from_lane int, to_lane int")
    return rows, connections
