"""Raster queries on 20,000 ways of up to 50,000 cells each: what they cost follows the ways and the cells, not their product (a billion)."""

import threading

import duckdb
import numpy as np
import pytest

from roadloom.operators import raster as R
from roadloom.plans import catalogue_lanes, catalogue_more, catalogue_roads

WAYS, MAPS, ROWS, COLS = 20_000, 40, 2_000, 25


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """Tables of ways with two nodes: one of the first 500, one of the last 500 in 4,000 lines of 50."""
    d = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    tables = {
        "part": "select k::bigint as p_partkey, 1 as p_size from range(200000) t(k) where k < 500 or k >= 199500",
        "orders": f"select k::bigint as o_orderkey, 'O' as o_orderstatus, '1' as o_orderpriority, 1.0::double as o_totalprice from range({WAYS}) t(k)",
        "lineitem": f"""select k::bigint as l_orderkey, case n when 0 then k * 7919 % 500 else 199500 + k * 104729 % 500 end::bigint as l_partkey, 1::bigint as l_suppkey, (n + 1)::int as l_linenumber, 1.0::double as l_quantity, 1.0::double as l_extendedprice,
          0.0::double as l_discount, 0.0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '2020-01-01' as l_shipdate from range({WAYS}) t(k), range(2) u(n)""",
    }
    for name, sql in tables.items():
        con.sql(f"copy ({sql}) to '{d}/{name}.parquet' (format parquet)")
    return str(d)


@pytest.fixture(scope="module")
def want():
    """(bits, lane_index) of (map, row, column), 0 and -1 where there is no cell, and the ways that reach a cell by map."""
    bits, index, related = np.zeros((MAPS, ROWS, COLS), int), np.full((MAPS, ROWS, COLS), -1), np.zeros(MAPS, int)
    for k in range(WAYS):
        (xa, ya), (xb, yb) = ((p % 50 * 10, p // 50 * 10) for p in (k * 7919 % 500, 199500 + k * 104729 % 500))
        rows = slice((min(ya, yb) + 9) // 20, (max(ya, yb) + 10) // 20)
        cols = slice((min(xa, xb) + 9) // 20, (max(xa, xb) + 10) // 20)
        at = k // 5 % MAPS, rows, cols
        bits[at] |= 1 << k // 20 % 8
        index[at] = k
        related[k // 5 % MAPS] += cols.start < cols.stop
    return bits, index, related


def within(spark, seconds, make):
    """The rows of a query that may take so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return make().toPandas()
    finally:
        timer.cancel()


def test_raster_cells(spark, large, want):
    bits, index, _ = want
    got = within(spark, 60, lambda: catalogue_more.raster_cells(spark, large))
    assert len(got) == (index >= 0).sum()
    at = got["map_id"], got["row"], got["col"]
    assert (bits[at] == got["bits"]).all() and (index[at] == got["lane_index"]).all()


def test_painted_over_many_tiles(spark):
    """Ranges of one cell up to 20 tiles, on both sides of 0, along both axes."""
    rng = np.random.default_rng(5)
    cells, rows = {}, []
    for k in range(60):
        a, b = (int(x) for x in rng.integers(-2600, 2600, 2))
        c, d = int(a + 2 ** rng.integers(0, 13)), int(b + rng.integers(0, 3))
        box = (a, c, b, d) if k % 2 else (b, d, a, c)
        rows.append((k % 2, *box, 1 << k % 8, k))
        for row in range(box[0], box[1] + 1):
            for col in range(box[2], box[3] + 1):
                seen = cells.get((k % 2, row, col), (0, 0))
                cells[k % 2, row, col] = seen[0] | 1 << k % 8, k
    # one that spans tiles both ways
    rows.append((2, -300, 900, -700, 520, 1, 7))
    cells |= {(2, row, col): (1, 7) for row in range(-300, 901) for col in range(-700, 521)}
    boxes = spark.createDataFrame(rows, "map_id long, r0 long, r1 long, c0 long, c1 long, bits int, top long")
    got = R.painted(boxes, ["bits"], ["top"]).toPandas()
    assert len(got) == len(cells)
    assert {(r[0], r[1], r[2]): (r[3], r[4]) for r in got.itertuples(index=False)} == cells
    assert not R.painted(boxes.limit(0), ["bits"], ["top"]).collect()


@pytest.mark.parametrize("factor", [2, 3, 7])
def test_painted_blocks_are_those_of_cells(spark, factor):
    """Boxes on both sides of 0, of one cell up to some blocks."""
    rng = np.random.default_rng(7)
    blocks, rows = {}, []
    for k in range(200):
        a, c = (int(x) for x in rng.integers(-300, 300, 2))
        box = a, a + int(rng.integers(0, 9)), c, c + int(rng.integers(0, 9))
        rows.append((k % 3, *box, 1 << k % 8, k))
        for row in range(box[0], box[1] + 1):
            for col in range(box[2], box[3] + 1):
                at = k % 3, row // factor, col // factor
                seen = blocks.get(at, (0, 0))
                blocks[at] = seen[0] | 1 << k % 8, k
    boxes = spark.createDataFrame(rows, "map_id long, r0 long, r1 long, c0 long, c1 long, bits int, top long")
    got = R.painted(R.block_ranges(boxes, factor), ["bits"], ["top"]).toPandas()
    assert len(got) == len(blocks)
    assert {(r[0], r[1], r[2]): (r[3], r[4]) for r in got.itertuples(index=False)} == blocks


def test_raster_coverage(spark, large, want):
    _, index, related = want
    got = within(spark, 60, lambda: catalogue_more.raster_coverage(spark, large)).set_index("map_id")
    for m in range(MAPS):
        row = got.loc[m]
        assert (row["total"], row["related"], row["encoded"]) == (WAYS // MAPS, related[m], len(np.unique(index[m][index[m] >= 0])))


def test_occupancy(spark, large, want):
    got = within(spark, 60, lambda: catalogue_more.occupancy(spark, large)).set_index("map_id")
    for m, there in enumerate(want[1] >= 0):
        rows, cols = np.nonzero(there)
        extent = (np.ptp(rows) + 1) * (np.ptp(cols) + 1)
        assert (got.loc[m, "free"], got.loc[m, "occupied"]) == (there.sum(), extent - there.sum())


def test_raster_layers(spark, large, want):
    got = within(spark, 60, lambda: catalogue_lanes.raster_layers(spark, large)).set_index("map_id")
    for m, there in enumerate(want[1] >= 0):
        row, col = np.nonzero(there)
        assert list(got.loc[m, ["drivable", "centerline", "anchor"]]) == [len(row), ((row * 3 + col) % 7 == 0).sum(), ((row + col) % 31 == 0).sum()]


def test_raster_blocks(spark, large, want):
    bits, index, _ = want
    got = within(spark, 60, lambda: catalogue_more.raster_blocks(spark, large))
    wide = np.pad(bits, ((0, 0), (0, 0), (0, 1))), np.pad(index, ((0, 0), (0, 0), (0, 1)), constant_values=-1)
    bits, index = (v.reshape(MAPS, ROWS // 2, 2, (COLS + 1) // 2, 2) for v in wide)
    bits, index = np.bitwise_or.reduce(np.bitwise_or.reduce(bits, 4), 2), index.max((2, 4))
    at = got["map_id"], got["row"], got["col"]
    assert len(got) == (index >= 0).sum() and (bits[at] == got["bits"]).all() and (index[at] == got["lane_index"]).all()


def test_raster_consistency(spark, large, want):
    got = within(spark, 60, lambda: catalogue_lanes.raster_consistency(spark, large)).set_index("map_id")
    for m, there in enumerate(want[1] >= 0):
        # drivable cells agree with occupied ones in row 3 of each ninth map
        off = there[3].sum() if m % 9 == 0 else 0
        assert (got.loc[m, "cells"], got.loc[m, "matching"]) == (there.sum(), there.sum() - off)


def test_raster_iou(spark, large, want):
    got = within(spark, 60, lambda: catalogue_roads.raster_iou(spark, large)).set_index("map_id")
    for m, there in enumerate(np.pad(want[1] >= 0, ((0, 0), (0, 0), (0, 1)))):
        moved = there.copy()
        moved[::9] = np.roll(there[::9], 1, axis=1)
        assert got.loc[m, "iou"] == pytest.approx((there & moved).sum() / (there | moved).sum(), abs=1e-6)


def test_raster_preview(spark, large, want):
    got = within(spark, 60, lambda: catalogue_lanes.raster_preview(spark, large)).set_index(["map_id", "layer"])["cells"].to_dict()
    counts = {}
    for m, there in enumerate(want[1] >= 0):
        row, col = np.nonzero(there)
        layer = np.select([(row + col) % 31 == 0, (row * 3 + col) % 7 == 0, (row + col) % 5 == 0], ["anchor", "centerline", "boundary"], "drivable")
        counts |= {(m, name): int(n) for name, n in zip(*np.unique(layer, return_counts=True), strict=True)}
    assert got == counts
