"""Coordinate frames of maps, and the transform between two of them or the reason why there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.functions import polyline as P

#: A frame: kind (geographic, projected or engineering), id of an engineering frame, zone of a UTM one, south of the equator.
FRAME = "struct<kind: string, id: string, zone: int, south: boolean>"


def how(source: Column, target: Column) -> Column:
    """identity for equal frames and engineering frames of one id, project from degrees to a zone, else refused."""
    equal = source.eqNullSafe(target)
    same = (source["kind"] == "engineering") & (target["kind"] == "engineering") & (F.coalesce(source["id"], F.lit("")) != "") & (source["id"] == target["id"])
    project = (source["kind"] == "geographic") & (target["kind"] == "projected") & target["zone"].isNotNull()
    return F.when(equal | F.coalesce(same, F.lit(False)), "identity").when(F.coalesce(project, F.lit(False)), "project").otherwise("refused")


def transformed(x: Column, y: Column, source: Column, target: Column, strict: bool = True) -> Column:
    """struct(x, y) in the target frame. Frames that can't be reconciled, and places that aren't finite, raise an error, or are null if not strict."""
    east, north = P.utm(x, y, target["zone"])
    north = north - F.when(y < 0, 10000000.0).otherwise(0.0) + F.when(F.coalesce(target["south"], F.lit(False)), 10000000.0).otherwise(0.0)
    way = how(source, target)
    out = F.when(way == "identity", F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).when(way == "project", F.struct(east.alias("x"), north.alias("y")))
    finite = out["x"].isNotNull() & out["y"].isNotNull() & ~F.isnan(out["x"]) & ~F.isnan(out["y"]) & (F.abs(out["x"]) < float("inf")) & (F.abs(out["y"]) < float("inf"))
    kept = F.when(F.coalesce(finite, F.lit(False)), out)
    if not strict:
        return kept
    why = F.when(way == "refused", "frames cannot be reconciled without a declared projection or identity").otherwise("a transformed place is not finite")
    return F.when(kept.isNotNull(), kept).otherwise(F.raise_error(why).cast("struct<x: double, y: double>"))
