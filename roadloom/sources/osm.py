"""XML maps of nodes, ways and relations (road networks and lane maps) as tables keyed by map_id, one scan for each element kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import polyline as P

_TAG = "tag array<struct<_k: string, _v: string>>"
_FLAGS = "_id string, _version string, _action string, _visible string"
SCHEMAS = {
    "node": f"{_FLAGS}, _lat string, _lon string, {_TAG}",
    "way": f"{_FLAGS}, nd array<struct<_ref: string>>, {_TAG}",
    "relation": f"{_FLAGS}, member array<struct<_type: string, _ref: string, _role: string>>, {_TAG}",
}
#: The map a file belongs to when none is told: its name without the extension.
MAP_ID = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$"


def map_id_of(path: Column) -> Column:
    return F.regexp_extract(path, MAP_ID, 1)


def finite(text: Column) -> Column:
    """A double, null where it can't be read or isn't finite."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.format("xml").schema(SCHEMAS[kind]).option("rowTag", kind).option("ignoreNamespace", "true").load(path)
    live = (F.coalesce("_action", F.lit("")) != "delete") & (F.coalesce("_visible", F.lit("")) != "false")
    tags = F.map_from_entries(F.array_distinct(F.transform(F.coalesce("tag", F.expr("array()")), lambda t: F.struct(t["_k"], t["_v"]))))
    return rows.where(live).withColumn("map_id", map_id_of(F.col("_metadata.file_path"))).withColumn("tags", tags)


@dataclass
class MapTables:
    """node(map_id, node_id, lon, lat, local_x, local_y, ele, tags), way(map_id, way_id, tags), way_node(map_id, way_id, pos, node_id),
    relation(map_id, rel_id, tags), member(map_id, rel_id, pos, type, ref, role)."""

    node: DataFrame
    way: DataFrame
    way_node: DataFrame
    relation: DataFrame
    member: DataFrame


def read(spark: SparkSession, path: str) -> MapTables:
    """All maps under a path or glob. Deleted elements are left out; a node with neither lon and lat nor local x and y is, too."""
    n = _elements(spark, path, "node")
    node = n.select("map_id", F.col("_id").alias("node_id"), finite(F.col("_lon")).alias("lon"), finite(F.col("_lat")).alias("lat"), finite(F.col("tags")["local_x"]).alias("local_x"), finite(F.col("tags")["local_y"]).alias("local_y"), finite(F.col("tags")["ele"]).alias("ele"), "tags")
    node = node.where("(lon is not null and lat is not null) or (local_x is not null and local_y is not null)")
    w = _elements(spark, path, "way")
    r = _elements(spark, path, "relation")
    refs = w.select("map_id", F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "nd")).select("map_id", "way_id", "pos", F.col("nd._ref").alias("node_id"))
    members = r.select("map_id", F.col("_id").alias("rel_id"), F.posexplode("member").alias("pos", "m")).select("map_id", "rel_id", "pos", F.col("m._type").alias("type"), F.col("m._ref").alias("ref"), F.col("m._role").alias("role"))
    return MapTables(node, w.select("map_id", F.col("_id").alias("way_id"), "tags"), refs, r.select("map_id", F.col("_id").alias("rel_id"), "tags"), members)


def frames(m: MapTables) -> DataFrame:
    """(map_id, local, zone, south, mode): local metres where every node that a way refers to has them, else the UTM zone of those nodes'
    mean longitude, north or south by their mean latitude."""
    used = m.node.join(m.way_node.select("map_id", "node_id").distinct(), ["map_id", "node_id"], "left_semi")
    means = used.groupBy("map_id").agg(F.bool_and(F.col("local_x").isNotNull() & F.col("local_y").isNotNull()).alias("local"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    zone = F.least(F.greatest(F.floor((F.col("lon") + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")
    code = F.when(F.col("lat") < 0, 32700).otherwise(32600) + zone
    return means.select("map_id", "local", zone.alias("zone"), (F.col("lat") < 0).alias("south"), F.when(F.col("local"), "local").otherwise(F.concat(F.lit("utm_epsg_"), code.cast("string"))).alias("mode"))


def coordinates(m: MapTables) -> DataFrame:
    """(map_id, node_id, x, y, mode): metres of every node that has them in its map's frame."""
    j = m.node.join(frames(m), "map_id")  # a row for each map
    # all of a map in one hemisphere's northing, whichever side of the equator a node is on
    east, north = P.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    north = north - F.when(F.col("lat") < 0, 10000000.0).otherwise(0.0) + F.when(F.col("south"), 10000000.0).otherwise(0.0)
    out = j.select("map_id", "node_id", F.when(F.col("local"), F.col("local_x")).otherwise(east).alias("x"), F.when(F.col("local"), F.col("local_y")).otherwise(north).alias("y"), "mode")
    return out.where("x is not null and y is not null")


def missing_nodes(m: MapTables) -> DataFrame:
    """References to nodes that the map doesn't have."""
    return m.way_node.join(m.node, ["map_id", "node_id"], "left_anti")


def lanelets(m: MapTables) -> DataFrame:
    """(map_id, lanelet_id, left_way, right_way, center_way, tags, skipped): the first member of a role counts; skipped says why a
    lanelet can't be used, null if it can."""
    ways = m.way.select("map_id", F.col("way_id").alias("ref"), F.lit(True).alias("known"))
    member = m.member.where("type = 'way'").join(ways, ["map_id", "ref"], "left")
    role = lambda name: F.min(F.when(F.col("role") == name, F.struct("pos", "ref", F.coalesce("known", F.lit(False)).alias("known"))))
    roles = member.groupBy("map_id", "rel_id").agg(role("left").alias("l"), role("right").alias("r"), role("centerline").alias("c"))
    rel = m.relation.where(F.col("tags")["type"] == "lanelet").join(roles, ["map_id", "rel_id"], "left")
    why = F.when(F.col("l").isNull(), "no left boundary").when(F.col("r").isNull(), "no right boundary").when(~F.col("l.known"), "left way is missing").when(~F.col("r.known"), "right way is missing")
    return rel.select("map_id", F.col("rel_id").alias("lanelet_id"), F.col("l.ref").alias("left_way"), F.col("r.ref").alias("right_way"), F.col("c.ref").alias("center_way"), "tags", why.alias("skipped"))


def regulatory(m: MapTables) -> DataFrame:
    """(map_id, reg_id, subtype, role, ref) of regulatory elements' members."""
    rel = m.relation.where(F.col("tags")["type"] == "regulatory_element").select("map_id", "rel_id", F.col("tags")["subtype"].alias("subtype"))
    kept = m.member.where(F.col("role").isin("refers", "ref_line", "yield", "right_of_way"))
    return rel.join(kept, ["map_id", "rel_id"]).select("map_id", F.col("rel_id").alias("reg_id"), "subtype", "role", "ref", "pos")


def restrictions(m: MapTables) -> DataFrame:
    """(map_id, rel_id, rule, from_way, via_type, via, to_way): turn restrictions that name all three members."""
    rel = m.relation.where(F.col("tags")["type"] == "restriction").select("map_id", "rel_id", F.col("tags")["restriction"].alias("rule"))
    pick = lambda role, what: F.min_by(F.when(F.col("role") == role, F.col(what)), F.when(F.col("role") == role, F.col("pos")))
    roles = m.member.groupBy("map_id", "rel_id").agg(pick("from", "ref").alias("from_way"), pick("via", "type").alias("via_type"), pick("via", "ref").alias("via"), pick("to", "ref").alias("to_way"))
    return rel.join(roles, ["map_id", "rel_id"]).where("from_way is not null and via is not null and to_way is not null")


# Road classes of the main layer.
MAIN_LAYER = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "living_street", "service"]
# Road classes of the layer beside it.
SUB_LAYER = ["path", "footway", "cycleway"]


def roads(m: MapTables, layer: list[str] = MAIN_LAYER, tunnels: bool = False) -> DataFrame:
    """Ways of a layer's classes with two nodes or more; tunnels only where asked for."""
    kept = m.way.where(F.col("tags")["highway"].isin(*layer))
    if not tunnels:
        kept = kept.where(F.coalesce(F.col("tags")["tunnel"], F.lit("no")) != "yes")
    long_ = m.way_node.groupBy("map_id", "way_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept.join(long_, ["map_id", "way_id"]).select("map_id", "way_id", "tags", "n")
