import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import documents, odd
from terrasurvey.llm import fmindex
from terrasurvey.llm.fmindex import FMIndex, WaveletTree, dedup_substrings, hashed_words, selected, shard_search


def plain(rows, k):
    """rows: (doc_id, text) -> Counter of (doc_id, n_words, n_removed, kept)."""
    first = {}
    cut = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in cut:
        for s in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[s : s + k])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in cut:
        gone = {s + j for s in range(len(w) - k + 1) for j in range(k) if i is not None and first[tuple(w[s : s + k])] < i}
        out[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    return out


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def made(seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice("xyz") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 15))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                words += p[a : len(p) - rng.randint(0, 5)]
        rows.append((i * 3 % 80, rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows + [(200, "go " * 60), (201, "go " * 40), (202, rows[5][1]), (203, rows[5][1])]


def test_equals_brute_force(spark):
    rows = made(1) + [(300, "one two three " * 9)] * 2 + odd(["alpha", "beta"])
    for k in (13, 7):
        assert rows_of(dedup_substrings(documents(spark, rows), k)) == plain(rows, k)
    assert dedup_substrings(documents(spark, [])).count() == 0


def test_hot_grams_and_many_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "HOT", 3)
    monkeypatch.setattr(fmindex, "SHARD", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = made(2)
        assert rows_of(dedup_substrings(documents(spark, rows), 13)) == plain(rows, 13)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_digest_of_the_query(spark):
    from terrasurvey.llm.fmindex import op8_substring_dedup

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, n, gone, kept) in plain(docs, 13).elements())
    assert rows_of(op8_substring_dedup(spark, sf)) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 1000))
def test_matching_statistics_equal_brute_force(texts, depth, seed):
    owners = np.random.default_rng(seed).integers(0, 6, len(texts))
    flat, lengths = np.concatenate([np.array(t) for t in texts]), np.array([len(t) for t in texts])
    got = FMIndex(flat, lengths, owners, depth).matching_statistics(flat, lengths, owners)
    want = []
    for i, t in enumerate(texts):
        known = {tuple(u[a : a + k]) for j, u in enumerate(texts) if owners[j] < owners[i] for k in range(1, depth + 1) for a in range(len(u) - k + 1)}
        want += [max([k for k in range(1, depth + 1) if s + k <= len(t) and tuple(t[s : s + k]) in known], default=0) for s in range(len(t))]
    assert got.tolist() == want


def test_texts_other_than_the_indexed_ones_can_be_streamed():
    index = FMIndex(np.array([1, 2, 3, 4, 5, 1, 2, 9]), np.array([5, 3]), np.array([0, 1]), 4)
    assert index.matching_statistics(np.array([9, 1, 2, 3, 4, 5, 5, 1, 2]), np.array([9]), np.array([2])).tolist() == [1, 4, 4, 3, 2, 1, 1, 2, 1]


def test_the_index_decides_what_is_repeated(monkeypatch):
    # one content holds another's windows beside words of its own: only the search tells
    a, b = [bytes(np.arange(x, x + 15, dtype="<u8")) for x in (100, 101)]
    rows = pa.table({"gram": [1, 1], "content": [a, b], "doc": [1, 2], "doc_key": [11, 22], "starts": [[0], [7]], "windows": pa.array([3, 3], pa.int32())})
    rows = rows.set_column(4, "starts", pa.array([[0], [7]], pa.list_(pa.int32())))
    assert shard_search(13)(rows).to_pylist() == [{"doc_key": 22, "start": 7, "windows": 2}]
    monkeypatch.setattr(FMIndex, "extended", lambda self, words, low, high: (low, low))
    assert shard_search(13)(rows).num_rows == 0


def test_word_hashes(monkeypatch):
    texts = ["one two\tone", None, "", " \n ", "x", "one", "two two  ", "Füße 中文\x0bone", "w" * 50 + " one"] * 3
    want = [w for t in texts for w in (t or "").encode().split()]
    for chunk in (1 << 20, 7, 1):
        monkeypatch.setattr(fmindex, "CHUNK", chunk)
        monkeypatch.setattr(fmindex, "POWERS", {fmindex.BASE: fmindex.powers(1, 0), fmindex.INVERSE: fmindex.powers(1, 0)})
        hashes, ends = hashed_words(pa.array(texts, pa.string()).cast(pa.binary()))
        assert np.diff(ends).tolist() == [len((t or "").encode().split()) for t in texts]
        named = {}
        assert all(named.setdefault(w, h) == h for w, h in zip(want, hashes.tolist(), strict=True))
        assert len(set(named.values())) == len(named)


def test_ids_of_another_type(spark):
    rows = made(3)
    docs = spark.createDataFrame([(f"d{i:04}", t) for i, t in rows], "doc_id string, text string")
    want = Counter((f"d{i:04}", n, gone, kept) for (i, n, gone, kept) in plain(rows, 13).elements())
    assert rows_of(dedup_substrings(docs, 13)) == want


def test_ranks():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, 500)
    tree = WaveletTree(x, 5)
    for symbol in range(20):
        places = np.arange(501)
        assert np.array_equal(tree.rank(np.full(501, symbol), places), [np.sum(x[:i] == symbol) for i in places])


def test_equal_windows_select_equal_grams():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 1 << 60, 13).astype(np.uint64)
    picks = set()
    for _ in range(20):
        a, b = rng.integers(0, 1 << 60, 9).astype(np.uint64), rng.integers(0, 1 << 60, 30).astype(np.uint64)
        text = np.concatenate((a, passage, b))
        first, place, gram = selected(text, np.array([0, len(text)]), 13)
        at = int(np.flatnonzero(first == len(a))[0])
        picks.add((int(place[at]) - len(a), int(gram[at])))
    assert len(picks) == 1
