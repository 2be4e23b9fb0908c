import random

from llm.rows import documents, odd
from terrasurvey.llm.lines import dedup_lines


def plain(rows, least):
    """rows: (doc_id, text), each once -> {doc_id: text without the lines of runs of `least` words or more that stand at an earlier place}."""
    seen, gone, order = set(), {}, sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    lines = {i: [(k, x.strip(" \t\n\r\x0b\x0c"), len(x.encode().split())) for k, x in enumerate((text or "").split("\n")) if x.encode().split()] for i, text in order}
    for i, _ in order:
        for s in range(len(lines[i])):
            new, words = [], 0
            for e in range(s + 1, len(lines[i]) + 1):
                words += lines[i][e - 1][2]
                if words >= least or (s, e) == (0, len(lines[i])):
                    key = tuple(x for _, x, _ in lines[i][s:e])
                    if key in seen:
                        gone.setdefault(i, set()).update(k for k, _, _ in lines[i][s:e])
                    new.append(key)
            seen.update(new)
    return {i: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ())) for i, text in order}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {k} " + "word " * rng.randint(0, 8) for k in range(25)] + ["", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\nmore"), (102, "short"), (103, " short\r")]
    for least in (1, 6, 15):
        got = dedup_lines(documents(spark, rows), least).collect()
        assert {r.doc_id: r.text for r in got} == plain(rows, least)


def test_odd_rows(spark):
    rows = odd(["alpha beta", "gamma"])
    docs = documents(spark, rows)
    for name in ("_doc", "_hash", "_runs", "_HASH_OF", "_own_hash", "part", "window", "print"):
        docs = docs.withColumn(name, docs.extra)
    out = dedup_lines(docs.withColumn("n_lines", docs.n_chars).withColumn("runs", docs.n_chars).withColumn("text_hash", docs.n_chars))
    assert set(out.columns) == {*docs.columns, "n_lines", "n_removed", "runs", "text_hash"}
    got = out.collect()
    assert len(got) == len(rows)
    texts = [(r.doc_id, r.text) for r in got]
    assert (1, None) in texts and (2, "") in texts and (3, " \n\t ") in texts and (5, "one two three") in texts
    assert [t for i, t in texts if i == 6] == ["", ""] and (None, "no id here") in texts
    assert dedup_lines(documents(spark, [])).count() == 0


def test_copies_lose_all_but_the_first(spark):
    text = "\n".join(f"this is line {k} of a longer text with words" for k in range(12))
    got = dedup_lines(documents(spark, [(i, text) for i in range(40)])).collect()
    assert {r.doc_id for r in got if r.text} == {0} and all(r.n_removed == 12 * (r.doc_id > 0) for r in got)


def test_the_short_end_of_a_match_goes_too(spark):
    text = "a long line of more than ten words that stands at the start\nshort end"
    rows = [(1, text), (2, "own words\n" + text + "\nmore"), (3, "short end"), (4, "other\nshort end")]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (text, 0), 2: ("own words\nmore", 2), 3: ("short end", 0), 4: ("other\nshort end", 0)}


def test_frequent_fingerprints_are_spread(spark):
    line = "a common line of a few words in very many documents indeed"
    got = dedup_lines(documents(spark, [(i, f"{line}\nown line {i}") for i in range(3000)])).collect()
    assert {r.doc_id: r.text for r in got} == {i: f"own line {i}" if i else f"{line}\nown line 0" for i in range(3000)}
