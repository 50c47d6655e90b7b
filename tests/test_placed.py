"""Way nodes without a shuffle by node: odd nodes, and what the plans deal."""

import duckdb
import pytest

from roadloom.plans import bridge, catalogue, catalogue_lanes, catalogue_more, catalogue_roads


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Ways with nodes that part has not, or twice; of one node, of one that counts twice, of repeated line numbers; orders twice or not there."""
    d = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    tables = {
        "part": "select k::bigint as p_partkey, 1 as p_size from range(3000) t(k) where k % 7 > 0 union all select k, 2 from range(0, 3000, 50) t(k)",
        "supplier": "select k::bigint as s_suppkey from range(90) t(k)",
        "orders": "select k::bigint as o_orderkey, 'O' as o_orderstatus, '1' as o_orderpriority, 1.0::double as o_totalprice from range(900) t(k) where k % 11 > 0 union all select k, 'F', '2', 2.0 from range(0, 900, 13) t(k)",
        "lineitem": """select k::bigint as l_orderkey, case when (k + n) % 41 = 0 then null else (k * 7919 + n * 104729) % 3100 end::bigint as l_partkey, 1::bigint as l_suppkey, (n // 2)::int as l_linenumber, 1.0::double as l_quantity,
          1.0::double as l_extendedprice, 0.0::double as l_discount, 0.0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '2020-01-01' as l_shipdate from range(900) t(k), range(6) u(n) where n <= k % 6""",
    }
    for name, sql in tables.items():
        con.sql(f"copy ({sql}) to '{d}/{name}.parquet' (format parquet)")
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet'")
    con.sql("create view events as select 1 as user_id, 1 as event_id, timestamp '2020-01-01' as ts, '' as event_type, 1.0 as value, '' as props")
    return str(d), con


def same(spark, odd, name):
    d, con = odd
    got = catalogue.QUERIES[name](spark, d).toPandas()
    want = con.sql(catalogue.ORACLE_SQL[name]).df()
    plain = lambda df: sorted(tuple(x if isinstance(x, str) else round(float(x), 5) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert len(want) and plain(got) == plain(want)


@pytest.fixture
def even(spark, tmp_path):
    """20,000 nodes that all are there once, and more of them than Spark may broadcast."""
    con = duckdb.connect()
    con.sql(f"copy (select k::bigint as p_partkey, 1 as p_size from range(20000) t(k)) to '{tmp_path}/part.parquet' (format parquet)")
    con.sql(f"copy (select k::bigint as o_orderkey, 'O' as o_orderstatus, '1' as o_orderpriority, 1.0::double as o_totalprice from range(9000) t(k)) to '{tmp_path}/orders.parquet' (format parquet)")
    rest = "1::bigint as l_suppkey, 1.0::double as l_quantity, 1.0::double as l_extendedprice, 0.0::double as l_discount, 0.0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '2020-01-01' as l_shipdate"
    con.sql(f"copy (select (k // 3)::bigint as l_orderkey, (k * 7919 % 20000)::bigint as l_partkey, (k % 3)::int as l_linenumber, {rest} from range(27000) t(k)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def by_node(df) -> int:
    """Shuffles by node in the plan of a query."""
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(node_id")


def test_nearest_sign_of_odd_nodes(spark, odd):
    same(spark, odd, "nearest_sign")


def test_starts_are_not_dealt_by_node(spark, even):
    starts = bridge.starts(spark, even)
    assert by_node(starts) == 0 and starts.count() == 9000


def test_starts_of_odd_nodes(spark, odd):
    d, con = odd
    starts = bridge.starts(spark, d)
    want = con.sql("WITH " + bridge.SQL.strip() + " SELECT DISTINCT way_id, sx, sy FROM b_end").limit(10_000).fetchall()
    assert sorted(map(tuple, starts.collect())) == sorted(want)


def test_nearest_sign_deals_each_way_once(spark, odd):
    """A way's start is found once: no second grouping by way follows the search."""
    plan = catalogue_lanes.nearest_sign(spark, odd[0])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(way_id" not in plan


RASTERS = ["occupancy", "raster_layers", "raster_blocks", "raster_consistency", "raster_iou", "raster_preview", "raster_cells", "raster_coverage"]


@pytest.mark.parametrize("name", RASTERS)
def test_rasters_of_odd_nodes(spark, odd, name):
    same(spark, odd, name)


def test_boxes_are_not_dealt_by_node(spark, even):
    """What all rasters begin with: a row for each way is dealt, not one for each node of each way."""
    boxes = catalogue_more.boxes(spark, even)
    assert by_node(boxes) == 0 and boxes.count() == 9000


def test_boxes_of_odd_nodes(spark, odd):
    d, con = odd
    boxes = catalogue_more.boxes(spark, d)
    want = con.sql("WITH " + bridge.SQL.strip() + " SELECT map_id, way_id, min(x), min(y), max(x), max(y) FROM b_pt JOIN b_way USING (way_id) GROUP BY map_id, way_id").limit(10_000).fetchall()
    assert sorted(map(tuple, boxes.collect())) == sorted(want)


def test_iou_paints_once(spark, odd):
    plan = catalogue_roads.raster_iou(spark, odd[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_blocks_are_painted_as_such(spark, odd):
    """No cell is made to be grouped into its block: what paints gives the rows."""
    plan = catalogue_more.raster_blocks(spark, odd[0])._jdf.queryExecution().sparkPlan().toString()
    assert plan.startswith("FlatMapGroupsInArrow")


def test_boxes_deal_keys_of_nodes(spark, even):
    """A way's nodes are dealt by their keys, a long each, not as four sides that begin equal."""
    plan = catalogue_more.boxes(spark, even)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" not in plan.split("REPARTITION_BY_COL")[-1] and "REPARTITION_BY_COL" in plan


def test_odd_nodes(spark, tmp_path):
    """Used keys are compared as bits of 64: both ends of a block, keys below 0 and far ones."""
    used = [-9_000_000_000, -65, -64, -1, 0, 62, 63, 64, 127, 128, 9_000_000_063, 2**62]
    part = [(k, n) for k, n in zip(used, [0, 1, 0, 2, 1, 1, 3, 1, 0, 1, 1, 0], strict=True)] + [(1, 1), (65, 2), (-2, 1)]
    con = duckdb.connect()
    con.sql("create table lineitem (l_partkey bigint)")
    con.executemany("insert into lineitem values (?)", [[k] for k in [*used, *used[3:], None]])
    con.sql("create table part (p_partkey bigint)")
    con.executemany("insert into part values (?)", [[k] for k, n in part for _ in range(n)])
    for t in ("lineitem", "part"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = sorted(tuple(r) for r in bridge.odd_nodes(spark, str(tmp_path)).collect())
    assert got == sorted((k, n) for k, n in part if k in used and n != 1)


def test_consistency_paints_no_numbers(spark, odd):
    """Layers need no number of a way: pieces of ways that differ in nothing else are one."""
    assert "lane_index" not in catalogue_lanes.raster_consistency(spark, odd[0])._jdf.queryExecution().executedPlan().toString()


def test_preview_paints_no_numbers(spark, odd):
    """Nor does a preview, whose colours depend on the cell alone."""
    assert "lane_index" not in catalogue_lanes.raster_preview(spark, odd[0])._jdf.queryExecution().executedPlan().toString()
