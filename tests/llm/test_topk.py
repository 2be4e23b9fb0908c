import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasurvey.llm.topk import SortedLists, top_k


def plain(ids, v, query_id, q, k):
    scored = sorted((-sum(int(a) * int(b) for a, b in zip(row, q, strict=True)), int(i)) for i, row in zip(ids, v, strict=True) if i != query_id)[:k]
    return [(i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, i in scored]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 200), st.integers(0, 8), st.integers(1, 7), st.integers(0, 2**31), st.sampled_from([2, 300, 2**28, 2**40]))
def test_search_equals_brute_force(n, d, k, seed, most):
    rng = np.random.default_rng(seed)
    v = rng.integers(-most, most + 1, (n, d)).astype(float)
    v[: n // 4] = v[-1]  # ties
    ids = rng.choice(1000, n, replace=False)
    lists = SortedLists(ids, v)
    for query_id, q in [*zip(ids[:9], v[:9], strict=True), (2000, rng.integers(-most, most + 1, d).astype(float)), (2001, np.zeros(d))]:
        found, read = lists.search(query_id, q, k, few=0)
        want = plain(ids, v, query_id, q, k)
        # scores beyond a long are all its end, and so tie
        assert [s for _, s in found] == [s for _, s in want] and (most >= 2**40 or found == want)
        assert read <= n * d


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(4000, 64)) / 8)
    ids = np.arange(4000)
    lists = SortedLists(ids, v)
    for i in range(5):
        found, read = lists.search(i, v[i], 5)
        assert found == plain(ids, v, i, v[i], 5) and read < 0.85 * v.size


def test_shards_and_blocks_give_the_same(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = sorted(map(tuple, top_k(vectors, F.col("vec_id") % 10 == 0).drop("n_read").collect()))
    many = sorted(map(tuple, top_k(vectors, F.col("vec_id") % 10 == 0, shard_rows=40, block_queries=7).drop("n_read").collect()))
    assert one == many and len(one) == 5 * vectors.where("vec_id % 10 = 0").count()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, None, 3), (3, [1.0, None], 4), (4, [nan, 1.0], 5), (5, [inf, 1.0], 6), (6, [0.5, 0.0], 7), (6, [0.5, 0.0], 7), (7, [1.0, 2.0, 3.0], 8), (8, [], 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, top_k(vectors.unionByName(vectors.limit(1).selectExpr("null as vec_id", "embedding", "score")), F.col("vec_id") % 50 == 0).drop("n_read").collect()))
    assert got == [(0, 1, 1, 256 * 256 + 512 * 512), (0, 2, 6, 256 * 128)]
    assert top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_components_too_large_for_a_long(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [1.0, 2.0]), (4, [0.0, 2.0]), (50, [0.0, 1.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).drop("n_read").collect()))
    most = (1 << 63) - 1
    assert got[:5] == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 4, 256 * 512), (0, 4, 50, 256 * 256), (0, 5, 2, -most - 1)]
    assert got[5:] == [(50, 1, 3, 256 * 512), (50, 2, 4, 256 * 512), (50, 3, 0, 256 * 256), (50, 4, 2, 0), (50, 5, 1, -256 * 256)]


def test_many_queries_at_once_read_heavy_lists_together():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(3000, 64)) / 8)
    ids = rng.permutation(3000)
    lists = SortedLists(ids, v)
    for (found, read), i in zip(lists.searches(ids[:40], v[:40], 5), range(40), strict=True):
        assert found == plain(ids, v, ids[i], v[i], 5) and 0.6 * v.size < read < 0.95 * v.size
    # three of eight lists are left to be read in blocks, and for a few rows only
    rows = []
    lists.narrowed = lambda may, *rest: rows.append(len(may)) or SortedLists.narrowed(lists, may, *rest)
    list(lists.searches(ids[:40], v[:40], 5))
    assert len(rows) == 40 and max(rows) < 1500
