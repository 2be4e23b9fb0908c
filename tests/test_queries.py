"""Every query with SQL gives DuckDB's rows; the others run and have rows."""

import os

import duckdb
import pandas as pd
import pytest

from terrasurvey.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "tolist") and not isinstance(v, (int, float)):
        v = v.tolist()
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(got)
