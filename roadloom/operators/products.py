"""Raster products of maps from sparse cells: preview colours, consistency, populated layers, metadata as JSON, and tagged image files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands in their order, and the colours of previews, the last that applies wins.
BANDS = ["drivable", "boundary", "centerline", "direction", "anchor", "lane_index"]
COLOURS = {"none": (24, 24, 24), "drivable": (226, 229, 220), "boundary": (245, 166, 35), "centerline": (38, 169, 184), "anchor": (69, 184, 107)}


def preview(drivable: Column, boundary: Column, centerline: Column, anchor: Column) -> Column:
    """The layer that colours a cell: anchors over centre lines over boundaries over drivable ground."""
    return F.when(anchor > 0, "anchor").when(centerline > 0, "centerline").when(boundary > 0, "boundary").when(drivable > 0, "drivable").otherwise("none")


def consistent(cells: DataFrame, by: str = "map_id") -> DataFrame:
    """(by, cells, matching, status): occupied is the opposite of drivable in every cell, or the products FAIL."""
    same = (F.col("drivable") > 0) != (F.col("occupied") > 0)
    c = cells.groupBy(by).agg(F.count("*").alias("cells"), F.count_if(same).alias("matching"))
    return c.withColumn("status", F.when(F.col("cells") == F.col("matching"), "PASS").otherwise("FAIL"))


def populated(cells: DataFrame, layers: list[str], by: str = "map_id") -> DataFrame:
    """(by, a count of non-zero cells for each layer, status): FAIL where a layer is empty."""
    c = cells.groupBy(by).agg(*[F.count_if(F.col(l) > 0).alias(l) for l in layers])
    return c.withColumn("status", F.when(F.least(*[F.col(l) for l in layers]) > 0, "PASS").otherwise("FAIL") if len(layers) > 1 else F.when(F.col(layers[0]) > 0, "PASS").otherwise("FAIL"))


def metadata(cells: DataFrame, frames: DataFrame, resolution: float, padding: float) -> DataFrame:
    """(map_id, json) of maps frames(map_id, mode, x0, y0, x1, y1, lanes): grid, bounds, encodings and counts beside a raster."""
    used = [c for c in BANDS if c in cells.columns]
    counts = cells.groupBy("map_id").agg(*[F.count_if(F.col(b) > 0).alias(b) for b in used])
    pixels = F.struct(*[F.coalesce(b, F.lit(0)).alias(b) for b in used])
    side = lambda a, b: F.ceil((F.col(b) - F.col(a)) / resolution).cast("long")
    record = F.struct(
        F.lit("lane-raster-metadata/v1").alias("schema"),
        F.map_from_arrays(F.array(*[F.lit(str(k + 1)) for k in range(len(BANDS))]), F.array(*map(F.lit, BANDS))).alias("bands"),
        F.struct(F.lit(0).alias("free"), F.lit(1).alias("occupied")).alias("occupancy_encoding"),
        F.col("mode").alias("coordinate_mode"),
        F.struct("x0", "y0", "x1", "y1").alias("bounds"),
        F.lit(resolution).alias("resolution_m"),
        F.lit(padding).alias("padding_m"),
        side("x0", "x1").alias("width"),
        side("y0", "y1").alias("height"),
        F.col("lanes").alias("lanes"),
        pixels.alias("pixels"),
    )
    return frames.join(counts, "map_id", "left").select("map_id", F.to_json(record).alias("json"))


def _image(bands: np.ndarray) -> bytes:
    """A little-endian tagged image file of (bands, height, width) 16-bit values, one deflated strip for each band."""
    n, height, width = bands.shape
    strips = [zlib.compress(b.astype("<u2").tobytes(), 6) for b in bands]
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16] * n), (259, 3, [8]), (262, 3, [1]), (273, 4, None), (277, 3, [n]), (278, 4, [height]), (279, 4, [len(s) for s in strips]), (284, 3, [2 if n > 1 else 1])]
    if n > 1:
        entries.append((338, 3, [0] * (n - 1)))
    size = 8 + 2 + 12 * len(entries) + 4
    extra, heads = b"", []
    places = size + sum(-(-len(v) * (2 if k == 3 else 4) // 4) * 4 for _, k, v in entries if v and len(v) * (2 if k == 3 else 4) > 4) + (4 * n if n > 1 else 0)
    offsets = np.cumsum([0, *map(len, strips)])[:-1] + places
    for tag, kind, values in entries:
        values = offsets.tolist() if values is None else values
        body = struct.pack("<" + ("H" if kind == 3 else "I") * len(values), *values)
        if len(body) <= 4:
            heads.append(struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        else:
            heads.append(struct.pack("<HHII", tag, kind, len(values), size + len(extra)))
            extra += body + b"\0" * (-len(body) % 4)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(heads) + struct.pack("<I", 0) + extra + b"".join(strips)


def images(cells: DataFrame, bands: list[str], most_pixels: int = 40_000_000) -> DataFrame:
    """(map_id, row0, col0, width, height, image): a map's cells, rows from the top, as one image of 16-bit bands. A map is one task's, and larger ones than
    most_pixels raise an error, so memory is bounded; values over 65,535 raise one, too."""
    kept = cells.select("map_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.coalesce(F.col(b).cast("long"), F.lit(0)).alias(b) for b in bands])

    def draw(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        r0, c0 = int(row.min()), int(col.min())
        height, width = int(row.max()) - r0 + 1, int(col.max()) - c0 + 1
        if height * width > most_pixels:
            raise ValueError(f"a map of {height * width} pixels, the bound is {most_pixels}")
        grid = np.zeros((len(bands), height, width), np.uint16)
        for k, b in enumerate(bands):
            values = table.column(b).to_numpy()
            if len(values) and (values.max() > 65535 or values.min() < 0):
                raise ValueError(f"{b} does not fit 16 bits")
            grid[k, height - 1 - (row - r0), col - c0] = values
        return pa.table({"map_id": table.column("map_id").slice(0, 1), "row0": [r0], "col0": [c0], "width": [width], "height": [height], "image": pa.array([_image(grid)], pa.binary())})

    kind = cells.schema["map_id"].dataType.simpleString()
    return kept.groupBy("map_id").applyInArrow(draw, f"map_id {kind}, row0 long, col0 long, width long, height long, image binary")
