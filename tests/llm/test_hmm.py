import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from llm.rows import documents, odd
from terrasurvey.llm import hmm
from terrasurvey.llm.hmm import Model, expected, log_likelihoods, op5_hmm, score


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [b""]


def base(rows):
    """rows: (doc_id, text, held_out) -> base columns of each."""
    counts = Counter(t for _, text, held in rows if not held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text, held in rows:
        ts = tokens(text)
        yield i, held, len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)


def agree(got, rows):
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0], r[2], r[3], r[5])
    for a, b in zip(sorted(got, key=key), sorted(base(rows), key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(a[6]) and a[6] <= 1e-9


def test_base_columns_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_hmm(spark, sf).collect()
    docs = [(r.doc_id, r.text, crc32(str(r.doc_id).encode()) % 5 == 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    agree(got, docs)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # states tell more than nothing: over 0.1 bits a token
    assert sum(r.score - r.base_score for r in held) / math.log10(2) > 0.1 * sum(r.n_tokens for r in held)


def test_words_beyond_the_head_are_counted_exactly(spark):
    rows = odd(["alpha", "Beta", "gamma"]) + [(20 + i, "alpha beta " * i + f"rare{i}") for i in range(20)]
    docs = documents(spark, rows)
    plain = [(r[0], r[1], r[0] is not None and r[0] % 3 == 1) for r in rows]
    for head, own in ((5, 2), (1000, 10)):
        agree(score(docs, F.col("doc_id") % 3 == 1, states=2, rounds=2, own=own, shapes=3, head=head).collect(), plain)
    assert score(documents(spark, []), F.lit(False)).count() == 0
    assert score(docs, F.lit(True)).count() == len(rows)


def test_probabilities_sum_to_one(spark):
    """Over all texts of up to some length, with one place for unseen words of each class, the probabilities approach 1."""
    docs = documents(spark, [(1, "a b"), (2, "b"), (3, ""), (4, "a a")])
    texts = [" ".join(w) for n in range(7) for w in itertools.product(["a", "b", "unseen"], repeat=n)]
    tested = documents(spark, [(100 + i, t) for i, t in enumerate(texts)])
    got = score(docs.unionByName(tested), F.col("doc_id") >= 100, states=2, rounds=2, own=1, shapes=1).where("held_out").collect()
    total = sum(10**r.score for r in got)
    assert 0.9 < total <= 1 + 1e-9


def test_scores_do_not_depend_on_how_rows_are_laid_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = []
    for n in (1, 7, 64):
        got = score(docs.repartition(n), F.crc32(F.col("doc_id").cast("string")) % 5 == 1, states=4, rounds=2, sample_rows=100).collect()
        seen.append({r.doc_id: r.score for r in got})
    for other in seen[1:]:
        assert other.keys() == seen[0].keys()
        assert all(math.isclose(other[i], x, rel_tol=1e-7) for i, x in seen[0].items())


def test_chunks_of_steps_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((9, 3)), 0))
    for lengths in ([5000], [300, 200, 200, 17, 1], [1, 1]):
        sequences = [rng.integers(0, 9, n) for n in lengths]
        monkeypatch.setattr(hmm, "CHUNK", 400_000)
        whole = [log_likelihoods(model, sequences), *expected(model, sequences)]
        for size in (1, 7, 256):
            monkeypatch.setattr(hmm, "CHUNK", size)
            for a, b in zip([log_likelihoods(model, sequences), *expected(model, sequences)], whole, strict=True):
                assert np.allclose(a, b, rtol=1e-10)


def test_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((4, 3)), 0))
    sequences = [np.array(s) for s in ([0, 3, 1, 2, 2], [1, 1], [3])]
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s, got in zip(sequences, log_likelihoods(model, sequences), strict=True):
        weight = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.step[a, b] * model.emit[x, b]
            weight[path] = p
        whole = sum(weight.values())
        assert math.isclose(got, math.log(whole))
        for path, p in weight.items():
            starts[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                steps[a, b] += p / whole
            for x, k in zip(s, path, strict=True):
                emits[x, k] += p / whole
    for a, b in zip(expected(model, sequences), (starts, steps, emits), strict=True):
        assert np.allclose(a, b)
