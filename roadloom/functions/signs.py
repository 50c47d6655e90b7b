"""Traffic signs written as text, and rules that tags stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a sign text of a town limit says.
TOWN = "y_limit"


def elements(text: Column) -> Column:
    """array<struct<sign, value>> of a traffic_sign text "DE:274[50],260;DE:...".

    Blocks are divided by semicolons and begin with a country prefix of three characters; signs by commas. 274 is a speed limit in m/s
    (274.1 the start of a zone, in km/h) after a colon or hyphen (a zone's also in brackets), and left out without a number; y_limit is a town sign; any other
    sign keeps a number in brackets as its value.
    """

    def one(sign: Column) -> Column:
        zone = F.startswith(sign, F.lit("274.1"))
        rest = F.when(zone, F.substring(sign, 6, 1 << 20)).otherwise(F.substring(sign, 5, 1 << 20))
        plain = F.when(F.substring(rest, 1, 1).isin("-", ":"), F.substring(rest, 2, 1 << 20)).when(F.startswith(rest, F.lit("[")) & F.contains(rest, F.lit("]")), F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)).otherwise(rest)
        number = plain.try_cast("double")
        speed = F.when(zone, F.struct(F.lit("zone").alias("sign"), number.alias("value"))).otherwise(F.struct(F.lit("limit").alias("sign"), (number / 3.6).alias("value")))
        own = F.struct(F.regexp_extract(sign, r"^([^\[]*)", 1).alias("sign"), F.regexp_extract(sign, r"\[([^\]]*)\]", 1).try_cast("double").alias("value"))
        return F.when(F.startswith(sign, F.lit("274")), F.when(number.isNotNull(), speed)).when(sign == TOWN, F.struct(F.lit("town").alias("sign"), F.lit(None).cast("double").alias("value"))).otherwise(own)

    blocks = F.transform(F.split(text, ";"), lambda b: F.split(F.substring(b, 4, 1 << 20), ","))
    return F.array_compact(F.transform(F.flatten(blocks), one))


def turn_bans(restrictions: Column) -> Column:
    """struct(left, through, right): whether an edge's restrictions forbid the turn."""
    has = lambda name: F.coalesce(F.array_contains(restrictions, name), F.lit(False))
    return F.struct(has("no_left_turn").alias("left"), has("no_straight_on").alias("through"), has("no_right_turn").alias("right"))


def turned_bans(restrictions: Column, side: Column) -> Column:
    """Restrictions at a fork without a way straight on: no_straight_on bans the turn to the given side instead."""
    moved = F.array_distinct(F.concat(F.array_remove(restrictions, "no_straight_on"), F.array(F.concat(F.lit("no_"), side, F.lit("_turn")))))
    return F.when(F.array_contains(restrictions, "no_straight_on"), moved).otherwise(restrictions)
