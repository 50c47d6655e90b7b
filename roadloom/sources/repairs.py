"""Repairs of source maps as expressions and joins: the source tables stay, a repaired copy and a note for each rule come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Curvatures this near count as equal.
NEAR = 1e-9
# Sign texts that say nothing, sign numbers that need a value they can't have alone, and signs of highway tags.
EMPTY_SIGNS = ["", "none", "unknown"]
BARE_ZONE_SIGNS = ["274.1", "274.2"]
PRIORITY_SIGNS = {"stop": "DE:206", "give_way": "DE:205", "yield": "DE:205"}


def version(value: Column) -> Column:
    """An element's version, 1 where it has none."""
    return F.when(F.coalesce(value, F.lit("")) == "", "1").otherwise(value)


def parsable_sign(value: Column) -> Column:
    """Whether a traffic_sign text can be read: blocks are divided by semicolons, signs of a block (after a country prefix) by commas."""
    blocks = F.split(value, ";")
    bare = F.transform(blocks, lambda b: F.when(F.contains(F.substring(b, 1, 3), F.lit(":")), F.substring(b, 4, 1 << 20)).otherwise(b))
    signs = F.flatten(F.transform(bare, lambda b: F.transform(F.split(b, ","), lambda v: F.trim(v))))
    return ~F.lower(F.trim(value)).isin(*EMPTY_SIGNS) & ~F.arrays_overlap(signs, F.array(*map(F.lit, BARE_ZONE_SIGNS)))


def with_priority_sign(highway: Column, sign: Column) -> Column:
    """The traffic_sign text with the sign that a stop or give-way highway tag stands for; unchanged if it is there."""
    kind = F.trim(highway)
    wanted = F.when(kind == "stop", PRIORITY_SIGNS["stop"]).when(kind.isin("give_way", "yield"), PRIORITY_SIGNS["yield"])
    values = F.filter(F.transform(F.split(F.coalesce(sign, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")
    more = F.when(sign.isNull(), wanted).otherwise(F.array_join(F.concat(values, F.array(wanted)), ";"))
    return F.when(wanted.isNull() | F.array_contains(values, F.coalesce(wanted, F.lit(""))), sign).otherwise(more)


def osm_repairs(elements: DataFrame) -> DataFrame:
    """elements(map_id, id, version, tags, ...) with version and tags repaired, and repairs: the names of the rules that changed a row.

    First unreadable signs go, then priority signs are added; rows that no rule changes come out as they are.
    """
    t = F.col("tags")
    sign = F.when(t["traffic_sign"].isNotNull() & parsable_sign(t["traffic_sign"]), t["traffic_sign"])
    rows = elements.withColumn("_sign", sign)
    rows = rows.withColumn("_full", with_priority_sign(t["highway"], F.col("_sign")))
    rule = lambda name, changed: F.when(changed, F.lit(name))
    notes = F.array_compact(
        F.array(
            rule("version", F.coalesce("version", F.lit("")) == ""),
            rule("traffic_sign", t["traffic_sign"].isNotNull() & F.col("_sign").isNull()),
            rule("priority_sign", ~F.col("_full").eqNullSafe(F.col("_sign"))),
        )
    )
    others = F.map_filter("tags", lambda k, _: k != "traffic_sign")
    tags = F.when(F.col("_full").eqNullSafe(t["traffic_sign"]), F.col("tags")).when(F.col("_full").isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit("traffic_sign"), F.col("_full"))))
    return rows.withColumn("repairs", notes).withColumn("tags", tags).withColumn("version", version(F.col("version"))).drop("_sign", "_full")


def integer_ids(ids: DataFrame) -> DataFrame:
    """(map_id, kind, id, number) for ids(map_id, kind, id) that aren't integers: the least positive numbers no id of the map has, by kind
    (roads before junctions) and id. What refers to an id joins this table; integer ids stay."""
    known = ids.select("map_id", "kind", "id").distinct().withColumn("value", F.when(F.col("id").rlike(r"^-?\d+$"), F.col("id").try_cast("bigint")))
    text = known.where(~F.col("id").rlike(r"^-?\d+$"))
    by = Window.partitionBy("map_id").orderBy(F.when(F.col("kind") == "road", 0).otherwise(1), "kind", "id")
    ranked = text.withColumn("k", F.row_number().over(by))
    # as many free numbers as needed are among the first (needed + used) ones
    size = known.groupBy("map_id").agg(F.count("*").alias("n"))
    free = size.select("map_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("number")).join(known.select("map_id", F.col("value").alias("number")), ["map_id", "number"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("map_id").orderBy("number")))
    return ranked.join(free, ["map_id", "k"]).select("map_id", "kind", "id", "number")


def plain_geometry(kind: Column, start: Column, end: Column) -> Column:
    """The kind of a geometry record: arcs without curvature and spirals that don't change it become lines or arcs."""
    straight = F.abs(start) <= NEAR
    constant = F.abs(start - end) <= F.greatest(F.lit(NEAR), NEAR * F.greatest(F.abs(start), F.abs(end)))
    return F.when((kind == "arc") & straight, "line").when((kind == "spiral") & constant & straight, "line").when((kind == "spiral") & constant, "arc").otherwise(kind)


def local_corners(corners: Column, s: Column, t: Column) -> Column:
    """Corners given along the road (s, t, dz) relative to an object's place: (u, v, z); corners without a place go."""
    placed = F.filter(corners, lambda c: c["s"].isNotNull() & c["t"].isNotNull())
    return F.transform(placed, lambda c: F.struct((c["s"] - F.coalesce(s, F.lit(0.0))).alias("u"), (c["t"] - F.coalesce(t, F.lit(0.0))).alias("v"), F.coalesce(c["dz"], F.lit(0.0)).alias("z")))


def usable_crosswalk(corners: Column) -> Column:
    """A crosswalk needs four corners with a place."""
    return F.size(F.filter(corners, lambda c: c["u"].isNotNull() & c["v"].isNotNull())) >= 4


def direct_connection(kind: Column, connecting: Column, linked: Column) -> Column:
    """The connecting road of a junction connection; in a direct junction the linked road stands in for a missing one."""
    return F.when((kind == "direct") & connecting.isNull(), linked).otherwise(connecting)
