"""The nearest place of every point, by brute force, near and far."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import joins as J


def within(spark, seconds, make):
    """The rows of a query that may take so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return make().toPandas()
    finally:
        timer.cancel()


def brute(points, places):
    """(id, distance) for (x, y) of points; places are (id, x, y)."""
    out = []
    for x, y in points:
        far = np.round(np.hypot(places[:, 1] - x, places[:, 2] - y), 6)
        out.append((int(places[far == far.min(), 0].min()), far.min()))
    return out


@pytest.mark.parametrize("kind", ["mixed", "lattice", "one", "row"])
def test_nearest_any_is_the_nearest(spark, kind):
    rng = np.random.default_rng(3)
    places = {"mixed": rng.normal(0, 100, (700, 2)), "lattice": rng.integers(0, 12, (900, 2)) * 10.0, "one": np.array([[5.0, -5.0]]), "row": np.array([[float(k), 0.0] for k in range(600)])}[kind]
    points = np.vstack([rng.normal(0, 100, (600, 2)), rng.integers(-3, 15, (600, 2)) * 5.0, rng.normal(0, 20000, (300, 2))])
    ids = rng.permutation(len(places))
    a = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "p long, x double, y double")
    b = spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in zip(ids, places, strict=True)], "q long, bx double, by double")
    got = {r.p: (r.q, r.distance) for r in J.nearest_any(a, b, "p", "q", ("x", "y"), ("bx", "by")).collect()}
    want = brute(points, np.column_stack([ids, places]))
    assert len(got) == len(points)
    for k, (q, distance) in enumerate(want):
        assert got[k] == (q, pytest.approx(distance, abs=2e-6))


def test_rows_without_a_place_and_repeated_ids(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, -0.0, 0.0)], "p long, x double, y double")
    b = spark.createDataFrame([(7, 10.0, 0.0), (6, 10.0, 0.0), (5, None, 1.0), (None, 0.0, 0.0)], "q long, bx double, by double")
    find = lambda a, b: within(spark, 60, lambda: J.nearest_any(a, b, "p", "q", ("x", "y"), ("bx", "by")))
    assert sorted(find(a, b).itertuples(index=False, name=None)) == [(1, 6, 1.0), (4, 6, 10.0)]
    assert len(find(a, b.limit(0))) == 0 and len(find(a.limit(0), b)) == 0


def far_tables(spark, d):
    """80,000 nodes in 1,600 lines, 60,000 places in the first 37 lines."""
    spark.range(80_000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{d}/part.parquet")
    spark.range(60_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{d}/supplier.parquet")
    return str(d)


def test_nearest_city_of_far_nodes(spark, tmp_path):
    from roadloom.plans import catalogue_roads

    got = within(spark, 60, lambda: catalogue_roads.nearest_city(spark, far_tables(spark, tmp_path)))
    assert len(got) == 80_000
    k = np.arange(1850)
    places = np.column_stack([k, k % 50 * 10.0, k % 37 * 10.0])
    some = got.sort_values("node_id")[::401]
    want = brute([(n % 50 * 10.0, n // 50 * 10.0) for n in some["node_id"]], places)
    assert [q for q, _ in want] == list(some["city"])


def test_nearest_sign_of_far_ways(spark, tmp_path):
    from roadloom.plans import catalogue_lanes

    d = far_tables(spark, tmp_path)
    k = F.col("id")
    ways = spark.range(80_000)
    ways.select(k.alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1").alias("o_orderpriority"), F.lit(1.0).alias("o_totalprice")).write.parquet(f"{d}/orders.parquet")
    one = {c: F.lit(1.0) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {c: F.lit("N") for c in ("l_returnflag", "l_linestatus")}
    rows = ways.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(k.alias("l_orderkey"), ((k + 7 * F.col("n") - 7) % 80_000).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.col("n").alias("l_linenumber"), F.current_timestamp().alias("l_shipdate"))
    rows.withColumns(one).write.parquet(f"{d}/lineitem.parquet")
    got = within(spark, 60, lambda: catalogue_lanes.nearest_sign(spark, d))
    assert len(got) == 80_000
    k = np.arange(1850)
    places = np.column_stack([k, k % 50 * 10.0 + 1, k % 37 * 10.0 + 2])
    some = got.sort_values("way_id")[::401]
    for (q, distance), r in zip(brute([(n % 50 * 10.0, n // 50 * 10.0) for n in some["way_id"]], places), some.itertuples(), strict=True):
        assert (q, distance) == (r.sign, pytest.approx(r.distance, abs=2e-6))
