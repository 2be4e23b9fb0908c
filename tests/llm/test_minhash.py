import hashlib
import random
import time

import numpy as np
import pytest

from llm.rows import documents, odd
from pyspark.sql import functions as F
from terrasurvey.llm.minhash import Hasher, in_order, op11_fingerprints, with_fingerprints

SF = "/root/testdata/sf0.01"


def runs(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """[(doc_id, n_chars, edited text, own text, next text)] of every row."""
    texts = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["hash"], r["text"] or "") for r in rows})
    after = {t: texts[(i + 1) % len(texts)][3] for i, t in enumerate(texts)}
    out = []
    for r in rows:
        text = r["text"] or ""
        follower = after[(r["doc_id"] is not None, r["doc_id"] or 0, r["hash"], text)]
        n = len(text) // 4
        out.append((r["doc_id"], len(text), text[: len(text) - n] + follower[:n], text, follower))
    return out


def check(spark, sf, docs, error):
    hashed = docs.withColumn("hash", F.xxhash64("text")).collect()
    want = plain([r.asDict() for r in hashed])
    rows = op11_fingerprints(spark, sf).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(((i, n, digest(t)) for i, n, t, _, _ in want), key=str)
    hasher = Hasher()
    by = {(i, n, digest(t)): (t, own, follower) for i, n, t, own, follower in want}
    off = []
    for r in rows:
        changed, own, follower = by[(r.doc_id, r.n_chars, r.edited_sha256)]
        marks = [hasher.fingerprint(x) for x in (own, changed, follower)]
        assert (r.fingerprint, r.edited_fingerprint) == (marks[0].hex(), marks[1].hex())
        assert (r.near_edited, r.near_next) == (hasher.likeness(*marks[:2]), hasher.likeness(marks[0], marks[2]))
        off += [r.near_edited - jaccard(own, changed), r.near_next - jaccard(own, follower)]
    assert not off or np.sqrt(np.mean(np.square(off))) < error
    return rows


def test_query_equals_brute_force(spark):
    rows = check(spark, SF, spark.read.parquet(f"{SF}/documents.parquet"), 0.03)
    assert len(rows) == 1000


@pytest.mark.parametrize("n", [0, 1, 2, 30])
def test_odd_rows(spark, tmp_path, n):
    rows = (odd(["x", "y\nz"]) + [(i, f"text number {i} of some words") for i in range(20, 41)])[:n]
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in ("fingerprint", "hash", "_range", "_guest")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert len(check(spark, str(tmp_path), docs, 0.3)) == n


def test_neighbours_across_ranges(spark, tmp_path):
    """Ranges of three rows: the last row of each is followed by the first of the next one."""
    docs = documents(spark, [(i // 2 * 3, f"{i} " * 20) for i in random.Random(1).sample(range(40), 40)])
    rows = in_order(docs, rows=3).collect()
    own, guests = [r for r in rows if not r._guest], [r for r in rows if r._guest]
    begins = {r._range: min((x.doc_id, x.hash) for x in own if x._range == r._range) for r in own}
    assert len(own) == 40 and len(begins) > 5
    assert {(r._range, r.doc_id, r.hash) for r in guests} == {((k - 1) % len(begins), *begins[k]) for k in begins}
    ends = [max((x.doc_id, x.hash) for x in own if x._range == k) for k in range(len(begins))]
    assert all(ends[k] < begins[k + 1] for k in range(len(begins) - 1))


def test_likeness_is_unbiased_for_sets_of_any_size():
    rng = np.random.default_rng(5)
    for size in (3, 20, 200, 5000):
        for share in (0.1, 0.5, 0.8):
            both, hasher, errors = max(1, round(size * share)), Hasher(bins=256, bits=2), []
            for _ in range(150):
                x = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) * np.uint64(2)
                a, b = np.unique(x[:size]), np.unique(np.concatenate((x[:both], x[size:])))
                low = [hasher.values(v) for v in (a, b)]
                errors.append(((low[0] == low[1]).mean() - 0.25) / 0.75 - both / (2 * size - both))
            assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(len(errors)) + 1e-3, (size, share)


def test_equal_words_hash_alike_wherever_they_stand():
    hasher = Hasher()
    a = hasher.hashes("one two  three\tfour five six".encode())
    assert len(a) == 2 and set(a) < set(hasher.hashes("zero one two three four five six ähm".encode()))
    assert set(hasher.hashes(b"a b c d e " * 300_000)) == set(hasher.hashes(b"a b c d e " * 2))
    assert hasher.fingerprint(" \n") == b"" and hasher.likeness(b"", b"") == 1.0


def test_time_is_linear():
    text = " ".join(map(str, range(200_000)))
    took = []
    for t in (text[:300_000], text[:1_200_000]):
        began = time.process_time()
        Hasher().fingerprint(t)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_fingerprints_ride_along(spark):
    docs = documents(spark, odd(["x", "y"])).withColumn("fingerprint", F.lit("own"))
    rows = with_fingerprints(docs).collect()
    assert len(rows) == len(odd(["x"])) and all(r.fingerprint == "own" for r in rows)
    assert {bytes(r.fingerprint_) for r in rows if not (r.text or "").split()} == {b""}
