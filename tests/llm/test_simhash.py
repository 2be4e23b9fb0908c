import random

import numpy as np
from xxhash import xxh64_intdigest

from llm.rows import documents, odd
from terrasurvey.llm.graph import components
from terrasurvey.llm.simhash import cell_links, embed, grid, manhattan, near_duplicates, near_links


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, names, most=4):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= most:
                up[find(i)] = find(j)
    low = {}
    for i, name in enumerate(names):
        r = find(i)
        low[r] = name if low.get(r) is None else low[r] if name is None else min(low[r], name)
    return [low[find(i)] for i in range(len(values))]


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(documents(spark, [(9000 + (r[0] or 0), r[1]) for r in odd(["Ab", "cd"])]).select("doc_id", "text"))
    rows = docs.collect()
    prints = [plain_print(r.text) for r in rows]
    want = sorted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, roots(prints, [r.doc_id for r in rows]), strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()) == want


def test_no_link_is_lost_in_large_and_split_cells(spark, monkeypatch):
    from terrasurvey.llm import simhash

    monkeypatch.setattr(simhash, "SPLIT", 50)
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    for n in (len(values), 10**7):
        links = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), n)
        got = {r.node: r.root for r in components(links).collect()}
        assert [got.get(x, x) for x in signed] == roots(values, signed)
        assert all((a & (1 << 64) - 1 ^ b & (1 << 64) - 1).bit_count() <= 4 for a, b in links.collect())


def test_manhattan_is_a_lower_bound_and_the_grid_finds_all():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 5000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)
    assert np.all(manhattan(embed(x), embed(y)) <= np.bitwise_count(x ^ y))
    for n in (1000, 10**6, 10**9):
        same = [(embed(x) & np.uint64(m & (1 << 64) - 1)) == (embed(y) & np.uint64(m & (1 << 64) - 1)) for m in grid(n, 4)]
        assert np.all(np.any(same, axis=0))


def test_rows_of_a_cell_may_be_spread_over_batches(spark):
    import pyarrow as pa

    batch = lambda cells, values: pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(values, pa.int64())], ["cell", "fp"])
    out = [b.to_pydict() for b in cell_links(4)(iter([batch([1, 2], [7, 8]), batch([2, 2], [9, 1 << 40]), batch([], []), batch([2, 3], [-1, 8])]))]
    assert {(a, b) for o in out for a, b in zip(o["a"], o["b"], strict=True)} == {(8, 9), (8, 1 << 40), (9, 1 << 40)}


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
