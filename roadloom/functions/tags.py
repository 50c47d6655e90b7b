"""Meaning of road tags as column expressions: speeds, lengths, turn lanes, lane counts, road profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanes, lane width in metres and speed in km/h that a road class has without tags.
ROAD_CLASSES = {
    "motorway": (6, 3.5, 120),
    "trunk": (4, 3.5, 100),
    "primary": (2, 3.5, 100),
    "secondary": (2, 3.5, 100),
    "tertiary": (2, 3.5, 100),
    "unclassified": (2, 3.5, 80),
    "residential": (2, 3.5, 50),
    "motorway_link": (2, 3.5, 80),
    "trunk_link": (2, 3.5, 80),
    "primary_link": (2, 3.5, 80),
    "secondary_link": (2, 3.5, 80),
    "tertiary_link": (2, 3.5, 80),
    "living_street": (2, 3.5, 7),
    "service": (2, 3.5, 10),
    "path": (1, 2.0, 8),
    "footway": (1, 2.0, 8),
    "cycleway": (1, 2.0, 20),
}
# Turn lanes that are kept as they are.
TURN_LANES = ["left", "through", "right", "slight_right", "slight_left", "merge_to_left", "merge_to_right", "through;right", "left;through", "left;through;right", "left;right", "none"]
# Oneway tags that mean yes.
ONE_WAY = ["yes", "true", "1", "-1"]


def _class_value(road_class: Column, index: int) -> Column:
    pairs = [x for name, values in ROAD_CLASSES.items() for x in (F.lit(name), F.lit(values[index]))]
    return F.create_map(*pairs)[road_class]


def speed(value: Column) -> Column:
    """Speed in m/s; null where it can't be read or signals set it."""
    number = value.try_cast("double")
    mph = F.regexp_extract(value, r"^\s*([0-9.]+)\s*mph$", 1).try_cast("double") * 1.609344
    kmh = (
        F.when(number.isNotNull(), number)
        .when(value == "walk", 7.0)
        .when(value == "none", 250.0)
        .when(value == "signals", None)
        .when(value.endswith("mph"), mph)
        .otherwise(_class_value(value, 2).cast("double"))
    )
    return kmh / 3.6


def metres(value: Column) -> Column:
    """A length in metres from "3.5", "3.5 m", "10 ft" or feet and inches; null where it can't be read, or isn't over 0."""
    text = F.lower(F.trim(value))
    plain = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*(m|metres?|meters?|ft|feet)?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*(m|metres?|meters?|ft|feet)?$", 2)
    feet = F.regexp_extract(text, r"""^([0-9]+)'\s*([0-9]+(?:\.[0-9]+)?)?"?$""", 1).try_cast("double")
    inches = F.coalesce(F.regexp_extract(text, r"""^([0-9]+)'\s*([0-9]+(?:\.[0-9]+)?)?"?$""", 2).try_cast("double"), F.lit(0.0))
    measured = plain * F.when(unit.isin("ft", "feet"), 0.3048).otherwise(1.0)
    return F.when(plain.isNotNull(), F.when(measured > 0, measured)).otherwise((feet * 12 + inches) * 0.0254)


def turn_lane(value: Column) -> Column:
    """A turn lane in the fixed vocabulary, else the parts of left, through and right that it names."""
    parts = F.concat_ws(";", *[F.when(F.contains(value, F.lit(p)), p) for p in ("left", "through", "right")])
    return F.when(value == "", "none").when(value.isin(*TURN_LANES), value).when(parts == "", "none").otherwise(parts)


def turn_lane_lists(both: Column, forward: Column, backward: Column, oneway: Column) -> tuple[Column, Column]:
    """Arrays of the forward and the backward turn lanes, null for none; on a one-way road the tag without a direction counts as forward."""
    known = F.coalesce(forward, F.when(F.coalesce(oneway, F.lit(False)), both))
    listed = lambda v: F.transform(F.split(v, r"\|"), lambda x: turn_lane(x))
    return listed(known), listed(backward)


def one_way(oneway: Column, junction: Column) -> Column:
    """true, false or null (unknown); a roundabout is one-way unless tagged otherwise."""
    return F.when(oneway.isNotNull(), oneway.isin(*ONE_WAY)).when(junction == "roundabout", True)


def with_lane_counts(df, total: str = "lanes", forward: str = "forward", backward: str = "backward", oneway: str = "oneway", road_class: str = "road_class"):
    """df with lanes, forward, backward, oneway completed and the flags flipped, lanes_assumed, split_assumed.

    In the order of the rules: parts override the total, a missing part is the rest, a one-way road with lanes against it becomes
    two-way, a road whose lanes all run backward is flipped, and what is still missing comes from the road's class.
    """
    t, f, b, o = (F.col(c) for c in ("_t", "_f", "_b", "_o"))
    df = df.withColumns({"_t": F.col(total), "_f": F.col(forward), "_b": F.col(backward), "_o": F.col(oneway)})
    # the total is the sum at least
    df = df.withColumn("_t", F.when(f.isNotNull() & b.isNotNull(), F.greatest(t, f + b)).otherwise(t))
    # a missing part is the rest, and never negative
    df = df.withColumns(
        {
            "_b": F.when(t.isNotNull() & b.isNull() & f.isNotNull(), F.greatest(t - f, F.lit(0))).otherwise(b),
            "_f": F.when(t.isNotNull() & f.isNull() & b.isNotNull(), F.greatest(t - b, F.lit(0))).otherwise(f),
        }
    )
    df = df.withColumn("_t", F.when(f.isNotNull() & b.isNotNull() & t.isNotNull(), F.greatest(t, f + b)).otherwise(t))
    against = F.coalesce(o & (b > 0), F.lit(False))
    df = df.withColumn("_o", F.when(against, False).otherwise(o)).withColumn("_one", F.coalesce(o, F.lit(False)))
    one = F.col("_one")
    df = df.withColumn("_b", F.when(one & b.isNull(), 0).otherwise(b)).withColumn("_f", F.when(one & f.isNull(), t).otherwise(f))
    df = df.withColumn("_t", F.when(f.isNotNull() & b.isNotNull(), f + b).otherwise(t))
    unknown = o.isNull() & t.isNotNull()
    all_forward, all_backward = F.coalesce(unknown & (f == t), F.lit(False)), F.coalesce(unknown & (b == t) & ~F.coalesce(f == t, F.lit(False)), F.lit(False))
    df = df.withColumn("flipped", all_backward)
    df = df.withColumns({"_f": F.when(F.col("flipped"), b).otherwise(f), "_b": F.when(F.col("flipped"), f).otherwise(b), "_o": F.when(all_forward | all_backward, True).otherwise(o)})
    # what is still missing
    usual = _class_value(F.col(road_class), 0)
    half = F.ceil(usual / 2).cast("int")
    df = df.withColumns({"_one": F.coalesce(o, F.lit(False)), "lanes_assumed": t.isNull(), "split_assumed": f.isNull() | b.isNull()})
    some = f.isNotNull() | b.isNotNull()
    guess = F.greatest(F.coalesce(f, F.lit(0)) + F.coalesce(b, F.lit(0)) + half, usual)
    df = df.withColumn("_t", F.when(t.isNotNull(), t).when(~some, F.when(one, half).otherwise(usual)).otherwise(F.when(one, F.greatest(F.lit(1), F.ceil(guess / 2).cast("int"))).otherwise(guess)))
    missing = F.col("split_assumed")
    df = df.withColumn("_b2", F.when(~missing, b).when(one, 0).when(f.isNotNull(), t - f).when(b.isNotNull(), b).otherwise(F.floor(t / 2).cast("int")))
    df = df.withColumn("_f2", F.when(~missing, f).when(one, t).when(f.isNotNull(), f).otherwise(t - F.col("_b2")))
    out = {total: t.cast("int"), forward: F.col("_f2").cast("int"), backward: F.col("_b2").cast("int"), oneway: F.col("_one")}
    return df.withColumns(out).drop("_t", "_f", "_b", "_o", "_one", "_f2", "_b2")


def with_width(df, width: str = "width", width_lanes: str = "width_lanes", est_width: str = "est_width", lanes: str = "lanes", road_class: str = "road_class"):
    """df with width_m, width_basis, lane_widths and estimated: the width tag, else the lanes' widths, else the estimate, else
    lanes by the class. Lane widths that are not one for each lane are replaced by equal shares."""
    default = F.coalesce(_class_value(F.col(road_class), 1), F.lit(3.5))
    listed = F.when(F.coalesce(F.col(width_lanes), F.lit("")) != "", F.transform(F.split(width_lanes, r"\|"), lambda v: F.coalesce(metres(v), default)))
    df = df.withColumn("_w", metres(F.col(width))).withColumn("_l", listed).withColumn("_e", metres(F.col(est_width)))
    total = F.aggregate("_l", F.lit(0.0), lambda s, v: s + v)
    n = F.greatest(F.col(lanes), F.lit(1))
    df = df.withColumn("width_m", F.coalesce("_w", total, "_e", n * default))
    basis = F.when(F.col("_w").isNotNull(), "width").when(F.col("_l").isNotNull(), "width:lanes").when(F.col("_e").isNotNull(), "est_width").otherwise("lanes_and_highway_defaults")
    df = df.withColumn("width_basis", basis)
    shares = F.when(F.coalesce(F.size("_l") == n, F.lit(False)), F.col("_l")).otherwise(F.array_repeat(F.col("width_m") / n, n))
    return df.withColumn("lane_widths", shares).withColumn("estimated", F.col("width_basis").isin("est_width", "lanes_and_highway_defaults")).drop("_w", "_l", "_e")


def lane_tag(tags: Column, key: str, direction: str, lane: Column) -> Column:
    """A lane's value of a key: from key:lanes:direction, else key:lanes, else key; lane counts from 1."""

    def part(k: str) -> Column:
        return F.nullif(F.try_element_at(F.split(tags[k], r"\|"), lane), F.lit(""))

    return F.coalesce(part(f"{key}:lanes:{direction}"), part(f"{key}:lanes"), tags[key])


def control_kind(tags: Column) -> Column:
    """sign for a traffic sign, speed limit or overtaking rule, else light."""
    keys = F.map_keys(tags)
    return F.when(F.arrays_overlap(keys, F.array(F.lit("traffic_sign"), F.lit("maxspeed"), F.lit("overtaking"))), "sign").otherwise("light")
