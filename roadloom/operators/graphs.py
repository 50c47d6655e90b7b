"""Graph operators over edge tables: components, chains, bounded reach, junction roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.storage import written


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over edges (src, dst) in either direction.

    Each round gives all nodes of a label the least label among the neighbours of any of them and then the label of that label,
    so whole parts merge at once and paths shorten by half.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("least"))
        hooked = labels.join(seen, labels["node"] == seen["src"], "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("was"))
        offers = hooked.groupBy("was").agg(F.min("component").alias("component"))
        hooked = hooked.drop("component").join(offers, "was").select("node", "component", "was")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = written(hooked.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "was"))
        if after.where("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
    raise RuntimeError(f"components: no fixpoint after {most_rounds} rounds")


def unique_links(edges: DataFrame) -> DataFrame:
    """Edges whose source has no other successor and whose target no other predecessor."""
    out = edges.withColumn("_o", F.count("*").over(Window.partitionBy("src"))).withColumn("_i", F.count("*").over(Window.partitionBy("dst")))
    return out.where("_o = 1 and _i = 1").drop("_o", "_i")


def chains(links: DataFrame, lengths: DataFrame, most_total: float, most_hops: int = 30) -> DataFrame:
    """(start, last, hops, total): walks along unique links (src, dst) from nodes without a predecessor, while the total length
    of (node, length) stays within most_total; a link back to the start ends a walk."""
    heads = links.select("src").distinct().join(links.select(F.col("dst").alias("src")), "src", "left_anti")
    size = lengths.select(F.col("node").alias("last"), F.col("length"))
    now = heads.select(F.col("src").alias("start"), F.col("src").alias("last")).join(size, "last").select("start", "last", F.lit(0).alias("hops"), F.col("length").alias("total"))
    done = None
    step = links.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    for _ in range(most_hops):
        moved = now.join(step, "last").join(size.withColumnRenamed("last", "next"), "next").where((F.col("total") + F.col("length") <= most_total) & (F.col("next") != F.col("start")))
        moved = written(moved.select("start", F.col("next").alias("last"), (F.col("hops") + 1).alias("hops"), (F.col("total") + F.col("length")).alias("total")))
        stopped = now.join(moved.select("start"), "start", "left_anti")
        done = stopped if done is None else done.unionAll(stopped)
        now = moved
        if moved.isEmpty():
            break
    return done if now.isEmpty() else done.unionAll(now)


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hops): nodes that each seed reaches in at most so many hops, with the fewest."""
    known = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    front = known
    for k in range(1, hops + 1):
        front = written(front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct().join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(k)))
        known = known.unionByName(front)
    return known
