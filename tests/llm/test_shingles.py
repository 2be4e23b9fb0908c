import random

import corpus_pipeline
from llm.rows import documents, odd
from terrasurvey.llm.shingles import near_copies


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def roots(texts, least=0.8):
    up, sets = list(range(len(texts))), [grams(t) for t in texts]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= least * len(x | sets[j]):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def edited(rng, n, edits):
    words = [f"w{rng.randint(0, 400)}" for _ in range(n)]
    out = [" ".join(words)]
    for k in edits:
        changed = list(words)
        for _ in range(k):
            changed[rng.randrange(n)] = f"x{rng.randint(0, 400)}"
        out.append(" ".join(changed))
    return out


def test_short_near_copies_equal_brute_force(spark, monkeypatch):
    from terrasurvey.llm import shingles

    rng = random.Random(3)
    texts = [t for _ in range(60) for t in edited(rng, rng.randint(50, 120), (1, 2, 3))]
    want = roots(texts)
    first = sorted({want.index(r) for r in want})
    assert 60 <= len(first) < len(texts) - 40
    docs = documents(spark, list(enumerate(texts)))
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == first
    monkeypatch.setattr(shingles, "SPLIT", 2)
    assert len({r._root for r in near_copies(docs, "doc_id").collect()}) == len(first)


def test_missing_and_shared_ids(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [*odd(["alpha", "beta"]), (20, long), (20, long.replace("word7 ", "other ")), (20, "a text of its own " + long[::-1]), (None, long), (None, long), (21, long.upper())]
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.simhash_dedup(spark, documents(spark, rows), "").collect())
    assert [t for i, t in got if i == 0] == ["no id here"]  # copies without an id go as well
    assert sorted(i for i, _ in got if i) == [1, 4, 5, 7, 20, 20] and any(t.startswith("a text of its own") for _, t in got)
    assert corpus_pipeline.simhash_dedup(spark, documents(spark, []), "").count() == 0


def test_simhash_links_without_any_band(spark, monkeypatch):
    from pyspark.sql import functions as F

    from terrasurvey.llm import shingles

    rng = random.Random(8)
    texts = [t for _ in range(12) for t in edited(rng, 600, (1, 2))]
    whole = shingles.with_bands
    # bands that no two texts share: what is linked, SimHash has linked
    monkeypatch.setattr(shingles, "with_bands", lambda docs, key, n: whole(docs, key, n).withColumn("_bands", F.array(*[F.xxhash64(key, F.lit(i)) for i in range(shingles.BANDS)])))
    found = {r.doc_id: r._root for r in near_copies(documents(spark, list(enumerate(texts))), "doc_id").collect()}
    want = roots(texts)
    linked = [i for i in range(len(texts)) if i % 3 and found[i] == found[i - i % 3]]
    assert len(linked) >= 12
    assert all(want[i] == want[j] for i in found for j in found if found[i] == found[j])


def test_known_links_are_not_compared_again():
    import numpy as np

    from terrasurvey.llm.shingles import linked

    rng, sets = random.Random(2), []
    for _ in range(15):
        base = rng.sample(range(10_000), 40)
        sets += [np.unique(np.array(base[: rng.randint(30, 40)] + [rng.randint(0, 10_000)], np.uint64)) for _ in range(6)]
    classes, plain = list(range(len(sets))), linked(list(range(len(sets))), sets, 0.8)

    def tops(links):
        up = list(range(len(sets)))
        for _ in up:
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    for some in (plain[::2], plain[1::3], plain):
        known = tops(some)
        rest = linked(classes, sets, 0.8, known)
        assert tops(some + rest) == tops(plain) and all(known[a] != known[b] for a, b in rest)
