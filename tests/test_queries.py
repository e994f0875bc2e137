"""Every query with an SQL twin, held against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from crestline.plans import all_plans

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value that compares alike whether Spark or DuckDB made it."""
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict") or isinstance(v, dict):
        v = v if isinstance(v, dict) else v.asDict()
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, (float, Decimal)) else v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(all_plans.queries()))
def test_query(spark, duck, name):
    got = all_plans.queries()[name](spark, SF)
    columns = sorted(got.columns)
    frame = got.select(*columns).toPandas()
    if name in all_plans.oracle_sql():
        want = duck.execute(all_plans.oracle_sql()[name]).df()
        assert sorted(want.columns) == columns
        assert rows(frame) == rows(want[columns])


def test_entry_contract():
    import __spark_entry__

    assert set(all_plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
