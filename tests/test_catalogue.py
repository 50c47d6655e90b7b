"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from roadloom.plans import catalogue, catalogue_lanes, catalogue_more, catalogue_roads, catalogue_rounds  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else float(x) if isinstance(x, Decimal) else x
    return int(x) if isinstance(x, float) and x.is_integer() else round(x, 9) if isinstance(x, float) else x


def rows(frame):
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = sql.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
