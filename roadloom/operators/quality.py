"""Checks of conversions: statuses, coverage, preservation, and round-trip measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses from the worst.
STATUSES = ["FAIL", "WARN", "REVIEW", "PASS", "SKIP", "UNKNOWN"]


def rank(status: Column) -> Column:
    """Place in STATUSES, 0 for the worst; any other status is the last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), status), F.lit(0)) - 1, F.lit(len(STATUSES) - 1)).cast("int")


def worst(status: Column) -> Column:
    """Aggregate: the worst status of a group."""
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.min(rank(status)) + 1)


def coverage(found: Column, expected: Column, warn_below: float) -> Column:
    """FAIL when nothing of what is expected was found, WARN under the ratio, SKIP when nothing is expected."""
    return F.when(expected == 0, "SKIP").when(found == 0, "FAIL").when(found < warn_below * expected, "WARN").otherwise("PASS")


def raster_coverage(related: Column, encoded: Column, total: Column) -> Column:
    """PASS from 0.99 related and 0.75 encoded, WARN from 0.95 related, else FAIL."""
    return F.when((related >= 0.99 * total) & (encoded >= 0.75 * total), "PASS").when(related >= 0.95 * total, "WARN").otherwise("FAIL")


def only_enabled(checks: DataFrame, enabled: list[str]) -> DataFrame:
    """Checks of disabled categories become SKIP rows."""
    return checks.withColumn("status", F.when(F.col("category").isin(*enabled), F.col("status")).otherwise("SKIP"))


def missing_edges(source: DataFrame, target: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (src, dst, role) of the source whose ends are both mapped (node, target) but not joined in the target."""
    ends = source.join(mapping.toDF("src", "to_src"), "src").join(mapping.toDF("dst", "to_dst"), "dst")
    there = target.select(F.col("src").alias("to_src"), F.col("dst").alias("to_dst"), "role")
    return ends.join(there, ["to_src", "to_dst", "role"], "left_anti").select("src", "dst", "role")


def inventory(source: DataFrame, target: DataFrame) -> DataFrame:
    """(map_id, expected, actual, missing, extra, status) of lane keys (map_id, key): FAIL without any lane or with missing ones, WARN with keys
    that the source hasn't, or with far fewer lanes than it has."""
    s, t = source.distinct().withColumn("s", F.lit(1)), target.distinct().withColumn("t", F.lit(1))
    c = s.join(t, ["map_id", "key"], "full").groupBy("map_id").agg(F.count("s").alias("expected"), F.count("t").alias("actual"), F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"))
    few = F.col("actual") < F.greatest(F.lit(1), F.floor(F.col("expected") * 0.35))
    status = F.when((F.col("expected") > 0) & (F.col("actual") == 0), "FAIL").when(F.col("missing") > 0, "FAIL").when((F.col("extra") > 0) | few, "WARN").otherwise("PASS")
    return c.withColumn("status", status)


def link_integrity(links: DataFrame, roads: DataFrame, others: DataFrame) -> DataFrame:
    """(road, links, unresolved, status) of links(road, other): FAIL where one names a road that isn't there."""
    known = links.join(roads.distinct().withColumn("k", F.lit(True)), "road", "left").join(others.distinct().withColumn("o", F.lit(True)), "other", "left")
    lost = F.col("k").isNull() | F.col("o").isNull()
    c = known.groupBy("road").agg(F.count("*").alias("links"), F.count_if(lost).alias("unresolved"))
    return c.withColumn("status", F.when(F.col("unresolved") > 0, "FAIL").otherwise("PASS"))


def carriers(source: DataFrame, target: DataFrame) -> DataFrame:
    """(map_id, categories, missing, status) of (map_id, category): WARN where a category of the source has nothing in the target."""
    s, t = source.select("map_id", "category").distinct(), target.select("map_id", "category").distinct().withColumn("t", F.lit(True))
    c = s.join(t, ["map_id", "category"], "left").groupBy("map_id").agg(F.count("*").alias("categories"), F.count_if(F.col("t").isNull()).alias("missing"))
    return c.withColumn("status", F.when(F.col("missing") > 0, "WARN").otherwise("PASS"))


def graded(found: Column, expected: Column) -> Column:
    """PASS when all is found, WARN from 95 %, else FAIL."""
    return F.when(found >= expected, "PASS").when(found >= 0.95 * expected, "WARN").otherwise("FAIL")
