"""Lanes of roads: generation from lane counts, links at a node of two roads, courses of links, common tags, adjacency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators import graphs as G
from roadloom.operators.storage import written

#: Share of the distance by which the inner control points of a link lie along its ends' directions.
BEZIER = 0.35


def generated(roads: DataFrame, width: float) -> DataFrame:
    """(road, place, forward, turn, left, right, left_same, offset) of roads(road, forward_lanes, backward_lanes, turns_forward, turns_backward).

    Lanes stand from the left: the backward ones, outermost first, then the forward ones. left and right are the places of a lane's
    neighbours as it runs, left_same whether the left one runs its way. turns are arrays from the left, null for none; offset is the distance
    of a lane's middle to the right of the road's.
    """
    n = F.col("forward_lanes") + F.col("backward_lanes")
    lanes = roads.where(n > 0).select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("place"))
    place, back = F.col("place"), F.col("backward_lanes")
    forward = place >= back
    turn = F.when(forward, F.get("turns_forward", place - back)).otherwise(F.get("turns_backward", F.size("turns_backward") - 1 - place))
    # a backward lane's left neighbour is the next to the right, as the road is drawn; the innermost one's is the first forward lane
    left = F.when(forward, F.when(place > back, place - 1).when(back > 0, back - 1)).otherwise(F.when(place < F.col("n") - 1, place + 1))
    right = F.when(forward, F.when(place < F.col("n") - 1, place + 1)).otherwise(F.when(place > 0, place - 1))
    same = F.when(left.isNotNull(), F.when(forward, place > back).otherwise(place < back - 1))
    return lanes.select("road", "place", forward.alias("forward"), F.coalesce(turn, F.lit("none")).alias("turn"), left.alias("left"), right.alias("right"), same.alias("left_same"), ((place - (F.col("n") - 1) / 2) * width).alias("offset"))


def merge_at_left(incoming: Column, outgoing: Column, last_in: Column, last_out: Column) -> Column:
    """Whether lanes that are too many go, or come, at the left: always, unless the last incoming lane turns left or a new last one turns right."""
    return ~(((incoming > outgoing) & (incoming >= 1) & F.contains(last_in, F.lit("left"))) | ((incoming < outgoing) & F.contains(last_out, F.lit("right"))))


def linked(pairs: DataFrame) -> DataFrame:
    """(link, src, dst): places of lanes that are joined where two roads meet, of pairs(link, incoming, outgoing, last_in, last_out).

    Lanes are joined place by place from the side where none come or go; the others join the outermost lane on the other side.
    """
    i, o = F.col("incoming"), F.col("outgoing")
    rows = pairs.where("incoming > 0 and outgoing > 0").withColumn("at_left", merge_at_left(i, o, F.col("last_in"), F.col("last_out")))
    one = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(i, o) - 1)))
    more = F.abs(i - o)
    # counted from the left; at the left the surplus lanes come first
    src = F.when(i >= o, F.col("k")).otherwise(F.when(F.col("at_left"), F.greatest(F.col("k") - more, F.lit(0))).otherwise(F.least(F.col("k"), i - 1)))
    dst = F.when(o >= i, F.col("k")).otherwise(F.when(F.col("at_left"), F.greatest(F.col("k") - more, F.lit(0))).otherwise(F.least(F.col("k"), o - 1)))
    return one.select("link", src.alias("src"), dst.alias("dst"))


def link_course(p1: Column, a: Column, p4: Column, b: Column) -> Column:
    """struct(kind, p2, p3) of a link from p1, coming from a, to p4, going on to b: a straight one where the ends meet or a direction is missing; a
    quadratic curve through where the directions cross ahead of both ends, unless that is too near one of them; else a cubic one."""
    sub = lambda p, q: F.struct((p["x"] - q["x"]).alias("x"), (p["y"] - q["y"]).alias("y"))
    size = lambda v: F.hypot(v["x"], v["y"])
    v1, v2, far = sub(p1, a), sub(p4, b), size(sub(p1, p4))
    scale = lambda v: F.struct((v["x"] / size(v) * far * BEZIER).alias("x"), (v["y"] / size(v) * far * BEZIER).alias("y"))
    w1, w2, d = scale(v1), scale(v2), sub(p1, p4)
    cross = w1["y"] * w2["x"] - w1["x"] * w2["y"]
    s1, s2 = (w2["y"] * d["x"] - w2["x"] * d["y"]) / cross, (w1["y"] * d["x"] - w1["x"] * d["y"]) / cross
    met = F.struct((p1["x"] + w1["x"] * s1).alias("x"), (p1["y"] + w1["y"] * s1).alias("y"))
    near = F.least(size(sub(met, p1)), size(sub(met, p4)))
    quadratic = (F.abs(cross) > 1e-9) & (s1 > 0) & (s2 > 0) & ((near > 1) | (near / far > 0.1))
    plus = lambda p, v: F.struct((p["x"] + v["x"]).alias("x"), (p["y"] + v["y"]).alias("y"))
    flat = (far < 1e-9) | (size(v1) < 1e-9) | (size(v2) < 1e-9)
    return F.when(flat, F.struct(F.lit("straight").alias("kind"), p1.alias("p2"), p4.alias("p3"))).when(F.coalesce(quadratic, F.lit(False)), F.struct(F.lit("quadratic").alias("kind"), met.alias("p2"), met.alias("p3"))).otherwise(F.struct(F.lit("cubic").alias("kind"), plus(p1, w1).alias("p2"), plus(p4, w2).alias("p3")))


def course_point(p1: Column, course: Column, p4: Column, t: float) -> Column:
    """The point of a link at t from 0 to 1."""

    def at(c: str) -> Column:
        straight = p1[c] + t * (p4[c] - p1[c])
        quadratic = (1 - t) ** 2 * p1[c] + 2 * t * (1 - t) * course["p2"][c] + t * t * p4[c]
        cubic = (1 - t) ** 3 * p1[c] + 3 * t * (1 - t) ** 2 * course["p2"][c] + 3 * t * t * (1 - t) * course["p3"][c] + t**3 * p4[c]
        return F.when(course["kind"] == "straight", straight).when(course["kind"] == "quadratic", quadratic).otherwise(cubic)

    return F.struct(at("x").alias("x"), at("y").alias("y"))


def common_tags(lanes: DataFrame, by: str) -> DataFrame:
    """(by, key, value) of tags(by, tags) that all rows of a group have with one value."""
    size = lanes.groupBy(by).agg(F.count("*").alias("n"))
    one = lanes.select(by, F.explode("tags").alias("key", "value")).groupBy(by, "key").agg(F.count("*").alias("c"), F.min("value").alias("value"), F.max("value").alias("other"))
    return one.join(size, by).where("c = n and value = other").select(by, "key", "value")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(src, role, neighbours): sorted arrays."""
    return edges.groupBy("src", "role").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, x, y) that are joined, over edges (src, dst) in either direction, to the node nearest to the origin (the least of equals)."""
    centre = nodes.orderBy(F.round(F.hypot("x", "y"), 6), "node").limit(1).select(F.col("node").alias("centre"))
    parts = G.components(nodes.select("node"), edges)
    kept = parts.join(F.broadcast(centre), F.col("node") == F.col("centre")).select("component")  # one row
    return nodes.join(parts.join(F.broadcast(kept), "component").select("node"), "node", "left_semi")


def road_groups(lanes: DataFrame, lateral: DataFrame, successors: DataFrame) -> DataFrame:
    """(lane, road, place): lanes that are side by side, over lateral (src, dst), make a road; roads with a lane that has no predecessor come
    first, as seeds, then the others, each by their least lane; place is the road's number from 1."""
    parts = G.components(lanes.select(F.col("lane").alias("node")), lateral)
    follows = successors.select(F.col("dst").alias("node")).distinct().withColumn("follows", F.lit(True))
    roads = parts.join(follows, "node", "left").groupBy("component").agg(F.bool_or(F.col("follows").isNull()).alias("seed"))
    placed = numbered(roads, [F.desc("seed"), F.col("component")])
    return parts.join(placed, "component").select(F.col("node").alias("lane"), F.col("component").alias("road"), "place")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, from 1, in a total order: rows are sorted by ranges, and partitions' sizes give where each begins."""
    spark = rows.sparkSession
    # rows carry their partition, so that the sizes and the rows are of one table
    sorted_ = written(rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_head"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_part", "_head", "_before")
    return sorted_.join(F.broadcast(before), "_part").withColumn("place", F.col("_at") - F.col("_head") + F.col("_before") + 1).drop("_part", "_at", "_head", "_before")
