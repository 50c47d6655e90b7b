"""Writers: maps of nodes, ways and relations as ordered XML text, a folder for each map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import polyline as P
from roadloom.sources.osm import MapTables

#: Longest tag value in bytes of UTF-8; longer values of metadata are cut into numbered tags.
MOST_TAG_BYTES = 255


def escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tags(tags: Column) -> Column:
    entries = F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>")))  # in the order of the source
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit('<tag k="'), escaped(e["key"]), F.lit('" v="'), escaped(e["value"]), F.lit('"/>'))), "")


def osm_lines(m: MapTables) -> DataFrame:
    """(map_id, kind, temporary, number, id, value): one line for each element, in the order of the file by the middle columns."""
    node = m.node.select("map_id", F.lit(1).alias("kind"), F.col("node_id").alias("id"), F.concat(F.lit('<node id="'), escaped(F.col("node_id")), F.lit('" version="1" lat="'), F.coalesce(F.col("lat").cast("string"), F.lit("")), F.lit('" lon="'), F.coalesce(F.col("lon").cast("string"), F.lit("")), F.lit('">'), _tags(F.col("tags")), F.lit("</node>")).alias("value"))
    refs = m.way_node.groupBy("map_id", "way_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda r: F.concat(F.lit('<nd ref="'), escaped(r["node_id"]), F.lit('"/>'))), "").alias("refs"))
    way = m.way.join(refs, ["map_id", "way_id"], "left").select("map_id", F.lit(2).alias("kind"), F.col("way_id").alias("id"), F.concat(F.lit('<way id="'), escaped(F.col("way_id")), F.lit('" version="1">'), F.coalesce("refs", F.lit("")), _tags(F.col("tags")), F.lit("</way>")).alias("value"))
    one = lambda r: F.concat(F.lit('<member type="'), escaped(r["type"]), F.lit('" ref="'), escaped(r["ref"]), F.lit('" role="'), escaped(r["role"]), F.lit('"/>'))
    members = m.member.groupBy("map_id", "rel_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "type", "ref", "role"))), one), "").alias("members"))
    rel = m.relation.join(members, ["map_id", "rel_id"], "left").select("map_id", F.lit(3).alias("kind"), F.col("rel_id").alias("id"), F.concat(F.lit('<relation id="'), escaped(F.col("rel_id")), F.lit('" version="1">'), F.coalesce("members", F.lit("")), _tags(F.col("tags")), F.lit("</relation>")).alias("value"))
    body = node.unionAll(way).unionAll(rel)
    maps = body.select("map_id").distinct()
    edge = maps.select("map_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit('<?xml version="1.0" encoding="UTF-8"?><osm version="0.6">').alias("value")), F.struct(F.lit(9).alias("kind"), F.lit("</osm>").alias("value")))).alias("e")).select("map_id", "e.kind", F.lit("").alias("id"), "e.value")
    number = F.col("id").try_cast("bigint")
    return body.unionAll(edge).select("map_id", "kind", F.when(number < 0, 0).otherwise(1).alias("temporary"), F.abs(number).alias("number"), "id", "value")


def write_osm(m: MapTables, path: str) -> None:
    """Each map as one ordered XML file in path/map_id=.../; nodes, ways, relations, temporary (negative) ids first."""
    lines = osm_lines(m)
    lines.repartition("map_id").sortWithinPartitions("map_id", "kind", "temporary", "number", "id").select("map_id", "value").write.partitionBy("map_id").mode("overwrite").text(path)


def _number(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)).cast("double").cast("string")


def road_lines(roads: DataFrame) -> DataFrame:
    """(map_id, road_id, value): a road element for each of roads(map_id, road_id, junction, line array<struct<x, y>>, lanes
    array<struct<id, type, width>>, pred_type, pred_id, pred_contact, succ_type, succ_id, succ_contact), children in the order of the schema.

    Plan view: a line record for each segment that has a length. Lanes of one section, positive ids on the left, each with one width.
    """
    segs = F.filter(P.segments(F.col("line")), lambda e: e["d"] > 0)
    start = F.expr("cast(array() as array<struct<s: double, e: struct<x0: double, y0: double, x1: double, y1: double, d: double>>>)")
    reached = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["s"] + F.element_at(acc, -1)["e"]["d"]).otherwise(0.0)
    placed = F.aggregate("segs", start, lambda acc, e: F.concat(acc, F.array(F.struct(reached(acc).alias("s"), e.alias("e")))))
    rows = roads.withColumn("segs", segs).withColumn("placed", placed).withColumn("length", F.aggregate("segs", F.lit(0.0), lambda a, e: a + e["d"]))
    record = lambda g: F.concat(F.lit('<geometry s="'), _number(g["s"]), F.lit('" x="'), _number(g["e"]["x0"]), F.lit('" y="'), _number(g["e"]["y0"]), F.lit('" hdg="'), _number(F.atan2(g["e"]["y1"] - g["e"]["y0"], g["e"]["x1"] - g["e"]["x0"])), F.lit('" length="'), _number(g["e"]["d"]), F.lit('"><line/></geometry>'))
    lane = lambda l: F.concat(F.lit('<lane id="'), l["id"].cast("string"), F.lit('" type="'), escaped(l["type"]), F.lit('" level="false"><width sOffset="0" a="'), _number(l["width"]), F.lit('" b="0" c="0" d="0"/></lane>'))

    def side(name: str, keep) -> Column:
        ordered = F.reverse(F.array_sort(F.filter("lanes", keep)))  # from the left: ids descend
        return F.when(F.size(ordered) > 0, F.concat(F.lit(f"<{name}>"), F.array_join(F.transform(ordered, lane), ""), F.lit(f"</{name}>"))).otherwise("")

    def link(name: str, short: str) -> Column:
        contact = F.when(F.col(f"{short}_contact").isNotNull(), F.concat(F.lit(' contactPoint="'), escaped(F.col(f"{short}_contact")), F.lit('"'))).otherwise("")
        return F.when(F.col(f"{short}_id").isNotNull(), F.concat(F.lit(f'<{name} elementType="'), escaped(F.coalesce(f"{short}_type", F.lit("road"))), F.lit('" elementId="'), escaped(F.col(f"{short}_id")), F.lit('"'), contact, F.lit("/>"))).otherwise("")

    value = F.concat(
        F.lit('<road name="" length="'), _number(F.col("length")), F.lit('" id="'), escaped(F.col("road_id")), F.lit('" junction="'), escaped(F.coalesce("junction", F.lit("-1"))), F.lit('"><link>'),
        link("predecessor", "pred"), link("successor", "succ"), F.lit("</link><planView>"), F.array_join(F.transform("placed", record), ""),
        F.lit('</planView><lanes><laneSection s="0">'), side("left", lambda l: l["id"] > 0), F.lit('<center><lane id="0" type="none" level="false"/></center>'), side("right", lambda l: l["id"] < 0), F.lit("</laneSection></lanes></road>"),
    )
    return rows.select("map_id", "road_id", value.alias("value"))


def junction_lines(connections: DataFrame) -> DataFrame:
    """(map_id, junction_id, value) of connections(map_id, junction_id, incoming, connecting, contact, from_lane, to_lane)."""
    links = connections.groupBy("map_id", "junction_id", "incoming", "connecting", "contact").agg(F.array_sort(F.collect_set(F.struct("from_lane", "to_lane"))).alias("links"))
    one = lambda l: F.concat(F.lit('<laneLink from="'), l["from_lane"].cast("string"), F.lit('" to="'), l["to_lane"].cast("string"), F.lit('"/>'))
    listed = links.groupBy("map_id", "junction_id").agg(F.array_sort(F.collect_list(F.struct("incoming", "connecting", "contact", "links"))).alias("c"))
    element = lambda c, k: F.concat(F.lit('<connection id="'), k.cast("string"), F.lit('" incomingRoad="'), escaped(c["incoming"]), F.lit('" connectingRoad="'), escaped(c["connecting"]), F.lit('" contactPoint="'), escaped(c["contact"]), F.lit('">'), F.array_join(F.transform(c["links"], one), ""), F.lit("</connection>"))
    value = F.concat(F.lit('<junction id="'), escaped(F.col("junction_id")), F.lit('" name="">'), F.array_join(F.transform("c", element), ""), F.lit("</junction>"))
    return listed.select("map_id", "junction_id", value.alias("value"))


def write_opendrive(roads: DataFrame, connections: DataFrame, path: str) -> None:
    """Each map as one XML file in path/map_id=.../: header, roads, junctions, by their ids."""
    body = road_lines(roads).select("map_id", F.lit(1).alias("kind"), F.col("road_id").alias("id"), "value").unionAll(junction_lines(connections).select("map_id", F.lit(2).alias("kind"), F.col("junction_id").alias("id"), "value"))
    head = '<?xml version="1.0" encoding="UTF-8"?><OpenDRIVE><header revMajor="1" revMinor="4" name="" version="1.00"/>'
    edge = body.select("map_id").distinct().select("map_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(head).alias("value")), F.struct(F.lit(9).alias("kind"), F.lit("</OpenDRIVE>").alias("value")))).alias("e")).select("map_id", "e.kind", F.lit("").alias("id"), "e.value")
    body.unionAll(edge).repartition("map_id").sortWithinPartitions("map_id", "kind", "id").select("map_id", "value").write.partitionBy("map_id").mode("overwrite").text(path)


def chunked_tag(key: Column, value: Column) -> Column:
    """A metadata value over MOST_TAG_BYTES bytes as numbered tags key:0, key:1, ...: an array of entries."""
    size = 60  # characters of at most 4 bytes stay under the bound
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(value) / size).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.concat(key, F.lit(":"), i.cast("string")).alias("key"), F.substring(value, i * size + 1, F.lit(size)).alias("value")))
    return F.when(F.octet_length(value) > MOST_TAG_BYTES, parts).otherwise(F.array(F.struct(key.alias("key"), value.alias("value"))))


def joined_tag(tags: Column, key: str) -> Column:
    """A value from its tag, or from its numbered tags when none is missing; else null."""
    own = F.filter(F.map_entries(tags), lambda e: F.startswith(e["key"], F.lit(key + ":")) & F.substring(e["key"], len(key) + 2, 12).try_cast("int").isNotNull())
    placed = F.array_sort(F.transform(own, lambda e: F.struct(F.substring(e["key"], len(key) + 2, 12).try_cast("int").alias("i"), e["value"].alias("v"))))
    whole = (F.size(placed) > 0) & (F.element_at(F.transform(placed, lambda p: p["i"]), -1) == F.size(placed) - 1)
    return F.coalesce(tags[key], F.when(whole, F.array_join(F.transform(placed, lambda p: p["v"]), "")))
