import random

import duckdb
import pytest

from llm.rows import documents
from terrasurvey.llm.mixing import OP7_SQL, mix


def test_equals_sql_with_a_stopped_source_nulls_and_ties(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 90)), "ab"[i % 2]) for i in range(200)]
    rows += [(300 + i, "five words in each one", "c") for i in range(4)] + [(400, None, "a"), (401, "", "c"), (402, " \n", None), (None, "no id here", None), (403, "no id here", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    order = lambda r: (r[0] is not None, r[0])
    want = sorted(con.execute(OP7_SQL).fetchall(), key=order)
    out = mix(documents(spark, rows)).collect()
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out), key=order)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    # stopped: every document three times
    assert {r.copies for r in out if r.source == "c"} == {3}


def test_nothing_is_added_where_whole_copies_meet_the_target(spark):
    rows = [(i, "" if i else "some words", "one") for i in range(30)]
    assert {r.copies for r in mix(documents(spark, rows)).collect()} == {1}


def test_empty_table(spark):
    assert mix(documents(spark, [])).count() == 0
