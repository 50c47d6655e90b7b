"""Whole maps: lane geometry, topology, rasters, conversion to road tables, and checks, all maps of a path in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import polyline as P
from roadloom.functions import tags as T
from roadloom.operators import joins as J
from roadloom.operators import quality as Q
from roadloom.operators import raster as R
from roadloom.settings import Settings
from roadloom.sources import opendrive, osm


def way_lines(m: osm.MapTables) -> DataFrame:
    """(map_id, way_id, line): ways with two known nodes or more; unknown nodes are passed over."""
    points = m.way_node.join(osm.coordinates(m).select("map_id", "node_id", "x", "y"), ["map_id", "node_id"])
    return points.groupBy("map_id", "way_id").agg(P.ordered().alias("line")).where(F.size("line") > 1)


def lane_geometry(m: osm.MapTables, samples: int = 20) -> DataFrame:
    """(map_id, lanelet_id, left_way, right_way, left, right, center, ring, width, direction): usable lanelets; the right
    boundary is turned where it runs against the left one."""
    lines = way_lines(m)
    usable = osm.lanelets(m).where("skipped is null").drop("skipped")
    left = lines.select("map_id", F.col("way_id").alias("left_way"), F.col("line").alias("left"))
    right = lines.select("map_id", F.col("way_id").alias("right_way"), F.col("line").alias("raw_right"))
    j = usable.join(left, ["map_id", "left_way"]).join(right, ["map_id", "right_way"])
    first, last = lambda c: F.col(c)[0], lambda c: F.element_at(c, -1)
    far = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    against = far(first("left"), first("raw_right")) + far(last("left"), last("raw_right")) > far(first("left"), last("raw_right")) + far(last("left"), first("raw_right"))
    j = j.withColumn("right", F.when(against, F.reverse("raw_right")).otherwise(F.col("raw_right"))).drop("raw_right")
    j = j.withColumn("l", P.resample(F.col("left"), P.length(F.col("left")), samples)).withColumn("r", P.resample(F.col("right"), P.length(F.col("right")), samples))
    center = F.zip_with("l", "r", lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    widths = F.array_sort(F.zip_with("l", "r", far))
    j = j.withColumn("center", center).withColumn("width", (widths[samples // 2 - 1] + widths[samples // 2]) / 2)
    head, tail = first("center"), last("center")
    return j.select("map_id", "lanelet_id", "left_way", "right_way", "tags", "left", "right", "center", F.concat("left", F.reverse("right")).alias("ring"), "width", P.direction_bit(tail["x"] - head["x"], tail["y"] - head["y"]).alias("direction"))


def lane_topology(m: osm.MapTables, settings: Settings | None = None) -> DataFrame:
    """(map_id, src, dst, role): lateral neighbours by shared boundaries, successors by end points within the tolerance."""
    settings = settings or Settings()
    lanes = lane_geometry(m)
    side = lanes.select("map_id", F.col("lanelet_id").alias("lane_id"), F.struct("map_id", "left_way").alias("left_way"), F.struct(F.col("map_id"), F.col("right_way").alias("left_way")).alias("right_way"))
    lateral = J.lateral_adjacency(side.withColumn("lane_id", F.struct("map_id", "lane_id")))
    lateral = lateral.select(F.col("src.map_id").alias("map_id"), F.col("src.lane_id").alias("src"), F.col("dst.lane_id").alias("dst"), "role")
    ends = lanes.select("map_id", "lanelet_id", F.col("center")[0].alias("s"), F.element_at("center", -1).alias("e"))
    a = ends.select("map_id", F.col("lanelet_id").alias("src"), F.col("e.x").alias("ex"), F.col("e.y").alias("ey"))
    b = ends.select("map_id", F.col("lanelet_id").alias("dst"), F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))
    after = J.epsilon_join(a, b, ("ex", "ey"), ("sx", "sy"), settings.endpoint_tolerance, ["map_id"]).where("src <> dst")
    after = after.select("map_id", "src", "dst", F.lit("successor").alias("role"))
    return lateral.unionByName(after).unionByName(after.select("map_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("predecessor").alias("role")))


def rasterize(m: osm.MapTables, settings: Settings | None = None) -> DataFrame:
    """(map_id, row, col, drivable, direction, lane_index): sparse cells whose centre is inside a lane, from the map's padded
    corner. Maps over the pixel cap raise an error."""
    settings = settings or Settings()
    lanes = lane_geometry(m)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = lanes.select("map_id", "lanelet_id", "ring", "direction", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    corner = box.groupBy("map_id").agg((F.min("x0") - settings.padding).alias("ox"), (F.min("y0") - settings.padding).alias("oy"), (F.max("x1") + settings.padding).alias("mx"), (F.max("y1") + settings.padding).alias("my"))
    pixels = F.ceil((F.col("mx") - F.col("ox")) / settings.resolution) * F.ceil((F.col("my") - F.col("oy")) / settings.resolution)
    corner = corner.withColumn("pixels", F.when(pixels <= settings.most_pixels, pixels).otherwise(F.raise_error(F.concat(F.lit("map over the pixel cap: "), "map_id")).cast("bigint")))
    moved = box.join(corner.where("pixels > 0"), "map_id")
    for c, o in (("x0", "ox"), ("x1", "ox"), ("y0", "oy"), ("y1", "oy")):
        moved = moved.withColumn(c, F.col(c) - F.col(o))
    number = F.dense_rank().over(Window.partitionBy("map_id").orderBy("lanelet_id"))
    cells = R.box_cells(moved.withColumn("number", number), "x0", "y0", "x1", "y1", settings.resolution)
    x, y = F.col("ox") + (F.col("col") + 0.5) * settings.resolution, F.col("oy") + (F.col("row") + 0.5) * settings.resolution
    inside = cells.where(R.in_ring(F.col("ring"), x, y))
    return inside.groupBy("map_id", "row", "col").agg(F.lit(1).alias("drivable"), F.bit_or("direction").alias("direction"), F.max("number").alias("lane_index"))


def road_profiles(m: osm.MapTables) -> DataFrame:
    """(map_id, way_id, lanes, forward, backward, oneway, width_m, width_basis, lane_widths, estimated, speed) of a map's roads."""
    t = F.col("tags")
    count = lambda k: F.when(t[k].try_cast("int") >= 0, t[k].try_cast("int"))
    known = F.col("road_class").isin(*T.ROAD_CLASSES)
    r = osm.roads(m).select("map_id", "way_id", "tags", t["highway"].alias("road_class"), count("lanes").alias("lanes"), count("lanes:forward").alias("forward"), count("lanes:backward").alias("backward"), T.one_way(t["oneway"], t["junction"]).alias("oneway"))
    # turn lanes override lane counts
    forward, backward = T.turn_lane_lists(t["turn:lanes"], t["turn:lanes:forward"], t["turn:lanes:backward"], F.col("oneway"))
    r = r.withColumn("forward", F.when(forward.isNotNull(), F.size(forward)).otherwise(F.col("forward"))).withColumn("backward", F.when(backward.isNotNull(), F.size(backward)).otherwise(F.col("backward")))
    r = T.with_lane_counts(r.withColumn("road_class", F.when(known, F.col("road_class")).otherwise("unclassified")))
    r = T.with_width(r.withColumns({"width": t["width"], "width_lanes": t["width:lanes"], "est_width": t["est_width"]}))
    return r.select("map_id", "way_id", "road_class", "lanes", "forward", "backward", "oneway", "width_m", "width_basis", "lane_widths", "estimated", T.speed(F.coalesce(t["maxspeed"], F.col("road_class"))).alias("speed"))


def diagnose(m: osm.MapTables, settings: Settings | None = None) -> DataFrame:
    """(map_id, category, check, status, found, expected) of a map's own structure; disabled categories are SKIP."""
    settings = settings or Settings()
    lanelets = osm.lanelets(m)
    usable = lanelets.groupBy("map_id").agg(F.count("*").alias("expected"), F.count_if(F.col("skipped").isNull()).alias("found"))
    rows = usable.select("map_id", F.lit("structure").alias("category"), F.lit("usable lanelets").alias("check"), Q.coverage(F.col("found"), F.col("expected"), settings.warn_below).alias("status"), "found", "expected")
    refs = m.way_node.join(m.node.select("map_id", "node_id", F.lit(1).alias("known")), ["map_id", "node_id"], "left").groupBy("map_id").agg(F.count("*").alias("expected"), F.count("known").alias("found"))
    known = refs.select("map_id", F.lit("structure").alias("category"), F.lit("known node references").alias("check"), F.when(F.col("found") < F.col("expected"), "FAIL").otherwise("PASS").alias("status"), "found", "expected")
    return Q.only_enabled(rows.unionByName(known), list(settings.categories))


def read(spark: SparkSession, path: str, kind: str = "osm") -> osm.MapTables | opendrive.RoadTables:
    """Maps of a path or glob; kind: osm (also lane maps) or opendrive."""
    return {"osm": osm.read, "opendrive": opendrive.read}[kind](spark, path)
