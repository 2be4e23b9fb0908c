"""Equal pieces of rows count once, in whatever order they come."""

import os
import random

import duckdb
import pytest

from terrasurvey.operators import measures
from terrasurvey.plans.registry import QUERIES, SQL
from test_queries import SF, rows


def brute(pieces):
    """The length that intervals in whole metres cover together."""
    return float(len({x for a, b in pieces for x in range(int(a), int(b))}))


@pytest.mark.parametrize("seed", range(3))
def test_lengths_do_not_depend_on_order(spark, seed):
    rng = random.Random(seed)
    pieces = [(f"V{v}", f"R{r}", "regular", float(a), float(a + rng.randint(1, 4))) for v in range(3) for r in range(5) for a in (rng.randrange(0, 60, 3) for _ in range(30)) for _ in range(rng.randint(1, 4))]
    want = {key: brute([p[3:] for p in pieces if p[:2] == key]) for key in {p[:2] for p in pieces}}
    for parts in (1, 7, 40):
        rng.shuffle(pieces)
        table = spark.createDataFrame(pieces, "vineyard_id string, row_id string, row_structure string, a double, b double").repartition(parts)
        assert {(r.vineyard_id, r.row_id): r.row_length_m for r in measures.row_lengths(table).collect()} == want


def test_both_windows_share_one_sort(spark):
    pieces = spark.createDataFrame([("V", 0.0, 1.0)], "key string, a double, b double").repartition(3)
    plan = measures.covered(pieces, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1


def test_summary_of_repeated_pieces(spark, tmp_path):
    # each piece lies in the table one to four times; with one thread the SQL's two windows see equal pieces in one order
    c = duckdb.connect(config={"threads": 1})
    for f in os.listdir(SF):
        source = f"SELECT t.* FROM '{SF}/{f}' t, range(4) r(i) WHERE i <= l_partkey % 4" if f == "lineitem.parquet" else f"SELECT * FROM '{SF}/{f}'"
        c.execute(f"COPY ({source}) TO '{tmp_path}/{f}' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}'")
    assert rows(QUERIES["a07_survey_summary"](spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL["a07_survey_summary"]).df())
