"""Keys with more digits than names have room for: names are those of the SQL, and so are the rows."""

import os

import duckdb
import pytest

from terrasurvey.plans.registry import QUERIES, SQL
from test_queries import SF, rows

SHIFTED = {"customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_custkey",), "lineitem": ("l_partkey", "l_suppkey")}


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """(folder, connection) of the smallest tables, each row once as it is and once with keys of seven digits."""
    folder, c = str(tmp_path_factory.mktemp("long")), duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        far = ", ".join(f"{k} + i * 1234567 AS {k}" for k in SHIFTED.get(name, ()))
        order = ", o_orderkey + i * 6000000 AS o_orderkey" if name == "orders" else ", l_orderkey + i * 6000000 AS l_orderkey" if name == "lineitem" else ""
        source = f"SELECT t.* REPLACE ({far}{order}) FROM '{SF}/{f}' t, range(2) r(i)" if far else f"SELECT * FROM '{SF}/{f}'"
        c.execute(f"COPY ({source}) TO '{folder}/{f}' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{f}'")
    return folder, c


LONG_NAMES = [
    "a01_labels_per_tile", "a02_status_counts", "a03_progress", "a04_annotated_tiles", "a05_measurements", "a06_structure_votes", "a07_survey_summary", "a08_row_groups",
    "a09_grid_layout", "a16_merged_lengths", "a25_view_counts", "f01_grid_place", "g04_line_in_polygon", "g14_bounds",
]


@pytest.mark.parametrize("name", LONG_NAMES)
def test_long_keys(spark, long_keys, name):
    folder, c = long_keys
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(c.sql(SQL[name]).df())
