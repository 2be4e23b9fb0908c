import hashlib
import random
import zlib

import duckdb
import pytest

from llm.rows import documents, odd
from pyspark.sql import functions as F
from terrasurvey.llm.merkle import OP13_SQL, manifest, op13_merkle

SF = "/root/testdata/sf0.01"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, by whole trees."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            ways = []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    first = at - at % 3
                    ways.append((level[first:at], level[at + 1 : first + 3]))
                    at //= 3
            tampered = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and tampered is not None:
                tampered = tampered.replace("\n", "")
            fold = leaf(r, tampered)
            for a, b in ways:
                fold = sha(*a, fold, *b)
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], sha(*[x for a, b in ways for x in a + b]), fold, fold == top[-1][0]))
    return sorted(out, key=str)


FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got(op13_merkle(spark, SF))
    assert found == plain(rows) and {r[-1] for r in found} == {True, False}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert found == sorted(c.sql(f"SELECT {', '.join(FIELDS)} FROM ({OP13_SQL})").fetchall(), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 30])
def test_odd_rows(spark, tmp_path, n):
    rows = (odd(["x", "y\nz"]) + [(i, f"line\n{i}", f"s{i % 3}") for i in range(20, 41)])[:n]
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in ("pos", "size", "block", "node", "left", "_name", "kept_node")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert got(op13_merkle(spark, str(tmp_path))) == plain([r.asDict() for r in docs.collect()])


def folds(r, hit):
    at = hit or r["node"]
    for a, b in zip(r["left"], r["right"], strict=True):
        at = sha(a, at, b)
    return at


@pytest.mark.parametrize(("sizes", "most"), [([400, 1, 9, 10, 27, 28], 1000), ([400, 1, 9, 10, 27, 28] + [2] * 60, 40), ([1] * 200, 40)])
def test_blocks_of_one_or_two_levels_give_the_whole_tree(spark, sizes, most):
    """Small blocks and few nodes for the driver: sources of many blocks, and more sources than it takes."""
    rng = random.Random(1)
    rows = [(i, f"s{k:03}" if k else None, sha(str(rng.random()))) for k, n in enumerate(sizes) for i in range(n)]
    found = manifest(spark.createDataFrame(rows, "doc_id long, source string, node string"), depth=1, most=most).collect()
    trees = [tree([h for _, s, h in rows if s == (f"s{k:03}" if k else None)]) for k in range(len(sizes))]
    root = tree([t[-1][0] for t in trees])[-1][0]
    assert len(found) == len(rows) and {r["root"] for r in found} == {root}
    assert all(folds(r, None) == root and folds(r, sha("x")) != root for r in found)
    assert all(r["subroot"] == trees[int(r["source"][1:]) if r["source"] else 0][-1][0] for r in found)
