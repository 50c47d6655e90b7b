"""Joins that geometry needs: within a distance, nearest, as of, neighbours by shared boundaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.lanes import numbered
from roadloom.operators.storage import written


def epsilon_join(a: DataFrame, b: DataFrame, a_xy: tuple[str, str], b_xy: tuple[str, str], tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows within a distance, as an equi-join on grid cells of the tolerance: b is put in its cell and the eight around.

    Column names must differ but for keys, which both sides share and pairs agree on. Adds ``distance``. A pair meets in
    exactly one cell (that of a), so none comes twice; a hot cell is split by AQE like any skewed join key.
    """
    cell = lambda c, k: F.floor(F.col(c) / F.lit(tolerance)) + k
    left = a.withColumn("_cx", cell(a_xy[0], 0)).withColumn("_cy", cell(a_xy[1], 0))
    around = F.explode(F.array(*[F.struct(cell(b_xy[0], i).alias("_cx"), cell(b_xy[1], j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = b.withColumn("_c", around).select(*b.columns, "_c._cx", "_c._cy")
    far = F.hypot(F.col(a_xy[0]) - F.col(b_xy[0]), F.col(a_xy[1]) - F.col(b_xy[1]))
    return left.join(right, [*(keys or []), "_cx", "_cy"]).withColumn("distance", far).where(F.col("distance") <= tolerance).drop("_cx", "_cy")


def nearest_within(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_xy: tuple[str, str], b_xy: tuple[str, str], limit: float, keys: list[str] | None = None) -> DataFrame:
    """The nearest row of b for every row of a, the smaller id of equal distances; null beyond the limit. Equal ids don't pair."""
    near = epsilon_join(a, b, a_xy, b_xy, limit, keys).where(F.col(a_id) != F.col(b_id))
    best = near.groupBy(a_id).agg(F.min(F.struct(F.round("distance", 6).alias("distance"), F.col(b_id).alias("id"))).alias("best"))
    return a.join(best, a_id, "left").select(*a.columns, F.col("best.id").alias(b_id), F.col("best.distance").alias("distance"))


def lateral_adjacency(lanes: DataFrame) -> DataFrame:
    """(src, dst, role): the lane whose right boundary is this lane's left one is on its left, and the reverse."""
    a = lanes.select(F.col("lane_id").alias("src"), F.col("left_way").alias("way"))
    b = lanes.select(F.col("lane_id").alias("dst"), F.col("right_way").alias("way"))
    left = a.join(b, "way").where("src <> dst").select("src", "dst", F.lit("left").alias("role"))
    return left.unionAll(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("right").alias("role")))


def boundary_users(lanes: DataFrame) -> DataFrame:
    """(src, dst, side): all other lanes that use the boundary on a side of a lane, in any role."""
    uses = lanes.select("lane_id", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_way").alias("way")), F.struct(F.lit("right").alias("side"), F.col("right_way").alias("way")))).alias("u")).select("lane_id", "u.side", "u.way").where("way is not null")
    other = uses.select(F.col("lane_id").alias("dst"), "way").distinct()
    return uses.join(other, "way").where("lane_id <> dst").select(F.col("lane_id").alias("src"), "dst", "side").distinct()


def as_of(rows: DataFrame, by: str, order: list[str], is_record: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the last record before or at each row, of one table that holds both; one window, no range join."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(is_record, value), ignorenulls=True).over(w))


def merged_intervals(spans: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    """Overlapping or touching intervals of a key put together: (by, lo, hi, parts)."""
    w = Window.partitionBy(by).orderBy(lo, hi)
    reached = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col(lo) > reached, F.lit(True)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("parts")).drop("_island")


#: Points of a block of nearest_any, and places of one.
BLOCK_POINTS, BLOCK_PLACES = 512, 128


def _in_blocks(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], size: int) -> DataFrame:
    """Adds block: so many neighbouring points each, in the order of a curve of interleaved bits over a box."""

    def bits(c: str, lo: float, hi: float) -> Column:
        v = F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * (2**31 - 1)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    curve = bits(x, box[0], box[2]).bitwiseOR(F.shiftleft(bits(y, box[1], box[3]), 1))
    return numbered(points, [curve, F.col(x), F.col(y)]).withColumn("block", F.expr(f"(place - 1) div {size}")).drop("place")


def nearest_any(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_xy: tuple[str, str], b_xy: tuple[str, str], unique: bool = False) -> DataFrame:
    """(a_id, b_id, distance): the nearest row of b for every row of a, however far, the smaller id of equal distances (to 6 digits); b of no rows
    gives none. Rows without a finite place neither find nor are found. Rows of a that share an id count as one; unique says that none do.

    Equal places count once, on both sides. Places and points are dealt into blocks of neighbours; a block of points is held against the blocks of places
    whose boxes are no farther from it than the far side of the nearest one, so the distance to what is near does not matter.
    """
    placed = lambda df, xy: df.where((F.abs(F.col(xy[0])) < float("inf")) & (F.abs(F.col(xy[1])) < float("inf")))
    a = written(placed(a.select(a_id, F.col(a_xy[0]).cast("double").alias("_ax"), F.col(a_xy[1]).cast("double").alias("_ay")), ("_ax", "_ay")))
    b = placed(b.select(F.col(b_id).alias("_id"), F.col(b_xy[0]).cast("double").alias("_bx"), F.col(b_xy[1]).cast("double").alias("_by")), ("_bx", "_by")).where("_id is not null")
    points, places = a.select("_ax", "_ay").distinct(), b.groupBy("_bx", "_by").agg(F.min("_id").alias("_id"))
    box = points.unionAll(places.select("_bx", "_by")).agg(F.min("_ax"), F.min("_ay"), F.max("_ax"), F.max("_ay")).first()
    box = tuple(0.0 if v is None else v for v in box)
    points, places = _in_blocks(points, "_ax", "_ay", box, BLOCK_POINTS), _in_blocks(places, "_bx", "_by", box, BLOCK_PLACES).withColumnRenamed("block", "_of")
    sides = lambda df, of, x, y, p: df.groupBy(of).agg(F.min(x).alias(f"{p}x0"), F.max(x).alias(f"{p}x1"), F.min(y).alias(f"{p}y0"), F.max(y).alias(f"{p}y1"))
    pairs = sides(points, "block", "_ax", "_ay", "a").crossJoin(F.broadcast(sides(places, "_of", "_bx", "_by", "b")))
    gap = lambda c: F.greatest(F.col(f"a{c}0") - F.col(f"b{c}1"), F.col(f"b{c}0") - F.col(f"a{c}1"), F.lit(0.0))
    reach = lambda c: F.greatest(F.col(f"a{c}1") - F.col(f"b{c}0"), F.col(f"b{c}1") - F.col(f"a{c}0"))
    pairs = pairs.select("block", "_of", F.hypot(gap("x"), gap("y")).alias("_near"), F.hypot(reach("x"), reach("y")).alias("_far"))
    limit = pairs.groupBy("block").agg(F.min("_far").alias("_limit"))
    # distances that are equal to 6 digits differ by less than 2e-6
    held = pairs.join(limit, "block").where(F.col("_near") <= F.col("_limit") * (1 + 1e-12) + 2e-6).select("block", "_of")
    near = held.join(places, "_of").select(F.col("block").alias("_for"), "_id", "_bx", "_by")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ax, ay, bx, by = (t.column(c).to_numpy() for t, names in ((left, ("_ax", "_ay")), (right, ("_bx", "_by"))) for c in names)
        parts = [slice(k, k + BLOCK_PLACES) for k in range(0, len(bx), BLOCK_PLACES)] if len(ax) else []
        square = lambda at: (ax[:, None] - bx[at]) ** 2 + (ay[:, None] - by[at]) ** 2
        least = np.array([square(at).min(axis=1) for at in parts]).reshape(len(parts), len(ax))
        most = (np.sqrt(least.min(axis=0)) * (1 + 1e-12) + 2e-6) ** 2 if parts else None
        found = []
        for at, lowest in zip(parts, least, strict=True):
            if (lowest <= most).any():
                i, j = np.nonzero(square(at) <= most[:, None])
                found.append((i, j + at.start))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({**{c: left.column(c).take(pa.array(i)) for c in ("_ax", "_ay")}, **{c: right.column(c).take(pa.array(j)) for c in ("_bx", "_by", "_id")}})

    kind = b.schema["_id"].dataType.simpleString()
    equal = points.groupBy("block").cogroup(near.groupBy("_for")).applyInArrow(compare, f"_ax double, _ay double, _bx double, _by double, _id {kind}")
    far = F.round(F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")), 6)
    best = equal.groupBy("_ax", "_ay").agg(F.min(F.struct(far.alias("distance"), F.col("_id").alias("id"))).alias("best"))
    found = a.join(best, ["_ax", "_ay"])
    return (found if unique else found.groupBy(a_id).agg(F.min("best").alias("best"))).select(a_id, F.col("best.id").alias(b_id), F.col("best.distance").alias("distance"))


def weld(points: DataFrame, tolerance: float) -> DataFrame:
    """(map_id, id, onto) of points(map_id, id, x, y, z): in the order of ids, a point becomes the least kept one within the tolerance (of place
    and of height), and is kept if there is none; onto is the id itself for kept points.

    What a point becomes depends on the points before it, so a map's points are one task's.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        x, y, z = (table.column(c).to_pylist() for c in ("x", "y", "z"))
        bins: dict[tuple[int, int], list[int]] = {}
        onto = list(ids)
        for k in sorted(range(len(ids)), key=ids.__getitem__):
            cx, cy = math.floor(x[k] / tolerance), math.floor(y[k] / tolerance)
            near = [o for i in (-1, 0, 1) for j in (-1, 0, 1) for o in bins.get((cx + i, cy + j), ()) if abs(z[k] - z[o]) <= tolerance and math.hypot(x[k] - x[o], y[k] - y[o]) <= tolerance]
            if near:
                onto[k] = min(ids[o] for o in near)
            else:
                bins.setdefault((cx, cy), []).append(k)
        return pa.table({"map_id": table.column("map_id"), "id": table.column("id"), "onto": pa.array(onto, table.schema.field("id").type)})

    kept = points.select("map_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("z").cast("double"), F.lit(0.0)).alias("z"))
    m, i = (points.schema[c].dataType.simpleString() for c in ("map_id", "id"))
    return kept.groupBy("map_id").applyInArrow(run, f"map_id {m}, id {i}, onto {i}")


def coincident_adjacency(lanes: DataFrame, borders: DataFrame, tolerance: float) -> DataFrame:
    """(lane, side, other, same_direction): the lane beside each side of lanes(lane, left, right), by borders(border, start_node, end_node, line)
    that share both end nodes and whose points are within the tolerance, one by one.

    A lane's left border meets a right one drawn alike (same direction) or a left one drawn against it (opposite), and the other way round on
    the right; of several the same direction and then the least lane is taken.
    """
    use = lanes.select("lane", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("border")), F.struct(F.lit("right").alias("side"), F.col("right").alias("border")))).alias("u")).select("lane", "u.side", "u.border").join(borders, "border")
    a = use.select("lane", "side", "start_node", "end_node", F.col("line").alias("la"))
    alike = use.select(F.col("lane").alias("other"), F.col("side").alias("their"), "start_node", "end_node", F.col("line").alias("lb"), F.lit(True).alias("same"))
    against = use.select(F.col("lane").alias("other"), F.col("side").alias("their"), F.col("end_node").alias("start_node"), F.col("start_node").alias("end_node"), F.reverse("line").alias("lb"), F.lit(False).alias("same"))
    pairs = a.join(alike.unionAll(against), ["start_node", "end_node"]).where("lane <> other").where((F.col("side") == F.col("their")) != F.col("same")).where(F.size("la") == F.size("lb"))
    close = F.forall(F.zip_with("la", "lb", lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])), lambda d: d <= tolerance)
    return pairs.where(close).groupBy("lane", "side").agg(F.min(F.struct((~F.col("same")).alias("turned"), "other")).alias("m")).select("lane", "side", "m.other", (~F.col("m.turned")).alias("same_direction"))
