import re
from collections import Counter

from llm.rows import documents, odd
from terrasurvey.llm.quality import RULES, Text, cascade, judge, keep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(documents(spark, odd(["a", "b b", "c\u00a0d\x0b|"])).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    want = Counter((i, *plain(t)) for i, t in texts)
    rows = judge(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == set(want)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_keeps_clean_and_rejects_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    junk = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in judge(docs).where("kept").collect()}
    by_hand = {r.doc_id for r in docs.collect() if (t := Text((r.text or "").encode())).n >= 50 and 100 * t.repeat_words() <= 50 * t.n and not any(f(t) for f in RULES.values())}
    assert kept == by_hand == {r.doc_id for r in keep(docs).collect()}
    assert keep(docs).columns == docs.columns
    assert sorted(cascade(docs, RULES)) == sorted(RULES)


def test_cascade_prefers_cheap_rejections(spark):
    import time

    def slow(t):
        time.sleep(0.001)
        return True

    docs = documents(spark, [(i, "word " * 60) for i in range(50)])
    assert cascade(docs, {"slow": slow, "never": lambda t: False, "quick": lambda t: True})[0] == "quick"
    assert judge(documents(spark, [])).count() == 0
