"""Rasters as sparse cells: (map_id, row, col, values); a missing row is 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.storage import written


#: Rows and columns of a tile, a power of two; its cells are one task's work.
TILE_BITS = 8
TILE = 1 << TILE_BITS


def box_ranges(shapes: DataFrame, x0: str, y0: str, x1: str, y1: str, resolution: float) -> DataFrame:
    """Adds r0, r1, c0, c1: the first and last rows and columns whose centres lie in a shape's bounding box; shapes without any go."""
    r = F.lit(resolution)

    def first(v: str) -> Column:
        return F.ceil(F.col(v) / r - 0.5).cast("long")

    def last(v: str) -> Column:
        return F.floor(F.col(v) / r - 0.5).cast("long")

    return shapes.withColumns({"r0": first(y0), "r1": last(y1), "c0": first(x0), "c1": last(x1)}).where("r0 <= r1 and c0 <= c1")


def block_ranges(boxes: DataFrame, factor: int) -> DataFrame:
    """Boxes of cells as boxes of blocks of factor x factor: those with a cell in them. Painted, they are the blocks of the painted cells."""
    return boxes.withColumns({c: F.floor(F.col(c) / factor) for c in ("r0", "r1", "c0", "c1")})


def box_cells(shapes: DataFrame, x0: str, y0: str, x1: str, y1: str, resolution: float) -> DataFrame:
    """Cells whose centre lies in a shape's bounding box, only generated inside it: adds row and col. For products of whole boxes see painted."""
    kept = box_ranges(shapes, x0, y0, x1, y1, resolution).withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return kept.drop("r0", "r1", "c0", "c1")


def _level(lo: str, hi: str) -> Column:
    """k of the largest 2^k whole tiles between the tiles of both ends of a range; below 0 without a tile between them."""
    between = F.shiftright(hi, TILE_BITS) - F.shiftright(lo, TILE_BITS) - 1
    return F.when(between > 0, F.length(F.bin(between)) - 1).otherwise(-1)


def _pieces(lo: str, hi: str) -> Column:
    """A range as array of (level, tile, first, last): what it has of its end tiles, and the tiles between as two runs of 2^level tiles, which may overlap."""

    def piece(level: Column, tile: Column, first: Column, last: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), tile.cast("long").alias("tile"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    zero, end, k = F.lit(0), F.lit(TILE - 1), _level(lo, hi)
    t0, t1 = F.shiftright(lo, TILE_BITS), F.shiftright(hi, TILE_BITS)
    at0, at1 = F.col(lo).bitwiseAND(end), F.col(hi).bitwiseAND(end)
    run = F.pow(F.lit(2.0), k).cast("long")
    ends = F.array(piece(zero, t0, at0, end), piece(zero, t1, zero, at1))
    runs = F.array(piece(k, t0 + 1, zero, end), piece(k, t1 - run, zero, end))
    return F.when(t0 == t1, F.array(piece(zero, t0, at0, at1))).otherwise(F.when(k >= 0, F.concat(ends, runs)).otherwise(ends))


def _spread(table: np.ndarray, op: np.ufunc) -> np.ndarray:
    """Values of (row, column) from those of blocks (row level, column level, row, column) of 2^level rows and columns from there on."""
    for k in range(len(table) - 1, 0, -1):
        half = 1 << (k - 1)
        op(table[k - 1], table[k], out=table[k - 1])
        op(table[k - 1][:, half:], table[k][:, :-half], out=table[k - 1][:, half:])
    table = table[0]
    for k in range(len(table) - 1, 0, -1):
        half = 1 << (k - 1)
        op(table[k - 1], table[k], out=table[k - 1])
        op(table[k - 1][:, half:], table[k][:, :-half], out=table[k - 1][:, half:])
    return table[0]


def painted(boxes: DataFrame, bits: list[str], maxima: list[str]) -> DataFrame:
    """(map_id, row, col, bits, maxima) of the cells that boxes(map_id, r0, r1, c0, c1, ...) cover: bitwise OR of some integers, maximum of others, none null.

    What a box costs does not depend on its size: a range is two runs of 2^k that may overlap, as a value counts no more when taken twice. Boxes are
    cut at tiles; runs of whole tiles are halved down to single ones, a level at a time; a tile's blocks then are its task's, in arrays.
    """
    values = [*bits, *maxima]
    types = {c: boxes.schema[c].dataType.simpleString() for c in ("map_id", *values)}
    boxes = written(boxes.select("map_id", "r0", "r1", "c0", "c1", *values))
    merged = [*[F.bit_or(c).alias(c) for c in bits], *[F.max(c).alias(c) for c in maxima]]
    highest = boxes.agg(F.max(_level("r0", "r1")), F.max(_level("c0", "c1"))).first()
    pieces = boxes.select("map_id", F.explode(_pieces("r0", "r1")).alias("r"), "c0", "c1", *values).select("map_id", "r", F.explode(_pieces("c0", "c1")).alias("c"), *values)
    keys = ["map_id", *[f"{a}{k}" for a in "rc" for k in ("level", "tile", "first", "last")]]
    pieces = pieces.select("map_id", *[F.col(f"{a}.{k}").alias(f"{a}{k}") for a in "rc" for k in ("level", "tile", "first", "last")], *values)
    single = (F.col("rlevel") == 0) & (F.col("clevel") == 0)
    tiles, runs = pieces.where(single), pieces.where(~single)
    for axis, top in zip("rc", highest, strict=True):
        for k in range(top or 0, 0, -1):
            at = F.explode(F.when(F.col(f"{axis}level") == k, F.array(F.lit(0), F.lit(1 << (k - 1)))).otherwise(F.array(F.lit(0))))
            runs = runs.groupBy(*keys).agg(*merged).withColumn("_at", at).withColumn(f"{axis}tile", F.col(f"{axis}tile") + F.col("_at")).drop("_at")
            runs = runs.withColumn(f"{axis}level", F.least(f"{axis}level", F.lit(k - 1)))
    if max(top or 0 for top in highest) > 0:
        tiles = tiles.unionByName(runs)

    def paint(table: pa.Table) -> pa.Table:
        span = table.column("span").to_numpy().astype(np.int64)
        r0, r1, c0, c1 = (span >> k * TILE_BITS & (TILE - 1) for k in range(4))
        top, left = r0.min(), c0.min()
        height, width = int(r1.max() - top) + 1, int(c1.max() - left) + 1
        kr, kc = (np.frexp(n)[1].astype(np.int64) - 1 for n in (r1 - r0 + 1, c1 - c0 + 1))
        starts = [(kr, kc, r - top, c - left) for r in (r0, r1 + 1 - (1 << kr)) for c in (c0, c1 + 1 - (1 << kc))]

        def spread(v: np.ndarray, op: np.ufunc, empty: int) -> np.ndarray:
            blocks = np.full((int(kr.max()) + 1, int(kc.max()) + 1, height, width), empty, v.dtype)
            for at in starts:
                op.at(blocks, at, v)
            return _spread(blocks, op)

        row, col = np.nonzero(spread(np.ones(len(r0), np.uint8), np.bitwise_or, 0))
        out = {"map_id": table.column("map_id").take(pa.array(np.zeros(len(row), np.int64))), "row": row + top + table.column("rtile")[0].as_py() * TILE, "col": col + left + table.column("ctile")[0].as_py() * TILE}
        for c in values:
            op, empty = (np.bitwise_or, 0) if c in bits else (np.maximum, np.iinfo(np.int64).min)
            out[c] = pa.array(spread(table.column(c).to_numpy().astype(np.int64), op, empty)[row, col]).cast(table.schema.field(c).type)
        return pa.table(out)

    # dealt by tile, equal pieces become one before they are gathered; the four ends within a tile are one number
    ends = [F.shiftleft(F.col(c).cast("long"), k * TILE_BITS) for k, c in enumerate(("rfirst", "rlast", "cfirst", "clast"))]
    tiles = tiles.select("map_id", "rtile", "ctile", (ends[0] + ends[1] + ends[2] + ends[3]).alias("span"), *values)
    dealt = tiles.repartition("map_id", "rtile", "ctile").groupBy("map_id", "rtile", "ctile", "span").agg(*merged)
    return dealt.groupBy("map_id", "rtile", "ctile").applyInArrow(paint, f"map_id {types['map_id']}, row long, col long, " + ", ".join(f"{c} {types[c]}" for c in values))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring of corners, by counting crossings."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, nxt, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def supersampling(wanted: Column, width: Column, height: Column, cap: int = 40_000_000) -> Column:
    """Samples a pixel side that 4 x cap pixels allow, at least 1."""
    return F.greatest(F.lit(1), F.least(wanted, F.floor(F.sqrt(4.0 * cap / (width * height))).cast("int")))
