"""Areas whose ids are cut to one name are shapes of their own."""

import duckdb

from terrasurvey.plans.registry import QUERIES, SQL
from test_queries import rows


def test_overlay_of_areas_of_one_name(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT unnest(range(100000, 100120)) AS p_partkey, 5 AS p_size UNION ALL SELECT unnest(range(1000000, 1001200)), 7) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert rows(QUERIES["g01_polygon_overlay"](spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL["g01_polygon_overlay"]).df())
