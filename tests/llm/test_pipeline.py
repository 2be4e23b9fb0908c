from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm.test_lines import plain as without_repeats
from terrasurvey.llm.mixing import mix
from terrasurvey.llm.quality import RULES, Text


def similar(texts):
    """Of each text the index of the first one that it is linked to, directly or by way of others, by five-word shingles and 0.8 or more."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, first = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((top(i), top(j)))
                first[y] = x
    return [top(i) for i in range(len(texts))]


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: r.text for i, r in rows.items() if (t := Text((r.text or "").encode())).n >= 50 and 100 * t.repeat_words() <= 50 * t.n and not any(f(t) for f in RULES.values())}
    lines = without_repeats(list(kept.items()), 10)
    left = {i: t for i, t in lines.items() if t == kept[i] or any(x.strip() for x in t.split("\n"))}
    ids = sorted(left)
    unique = [i for k, (i, c) in enumerate(zip(ids, similar([left[i] for i in ids]), strict=True)) if k == c]
    # the mix is tested on its own: here its copies of the brute-force documents
    frame = spark.createDataFrame([(i, left[i], rows[i].source) for i in unique], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mix(frame).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({i: n * (len(t.encode(left[i], add_special_tokens=False).ids) + 1) for i, n in copies.items() if n})
    got, places = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for s in places.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024


#: Columns beside those of documents, with names that stages use themselves.
CLASHING = ["_row", "rest", "_ROOT", "copies", "_class", "n_lines", "n_removed", "raw", "_copy", "size", "hash", "piece"]


def table_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-"))).alias(c) for c in CLASHING])


def test_odd_rows_in_every_stage(spark):
    one = " ".join(f"word{i} text{i} line{i} here" for i in range(30))
    two = " ".join(f"other{i} words{i} in{i} there" for i in range(30))
    long = " ".join(f"tok{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n ", "en", "a", 3), (4, one, "en", "a", len(one)), (4, one, "en", "a", len(one))]
    rows += [(4, two, "en", "b", len(two)), (None, one, "en", "a", len(one)), (None, long, None, None, len(long)), (9, long + " end", "en", "b", 4 + len(long))]
    docs = table_of(spark, rows)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    whole = Counter((r[0], r[1]) for r in rows)
    quality, lines, near, mixed = (stage(spark, docs, "") for _, stage in corpus_pipeline.STAGES[:-1])
    for out in (quality, lines, near, mixed):
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}:{r.text if out is not lines else r[c].split(':', 1)[1]}" for r in out.where("text is not null").collect() for c in CLASHING)
    assert texts(quality) == Counter({k: n for k, n in whole.items() if k[1] and k[1].split()})
    # texts of one line: what stands with an earlier id (null first) goes as a whole, and the document with it
    assert texts(lines) == Counter({(1, None): 1, (2, ""): 1, (3, " \n "): 1, (None, one): 1, (4, two): 1, (None, long): 1, (9, long + " end"): 1})
    blank = [k for k in texts(near) if not (k[1] or "").split()]
    assert blank == [(1, None)] and texts(near) == Counter({(1, None): 1, (4, one): 1, (4, two): 1, (9, long + " end"): 1})
    assert set(texts(mixed)) <= set(whole) and all(n <= 3 * whole[k] for k, n in texts(mixed).items())
    packed = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_near_copies_leave_one(spark):
    text = " ".join(f"word{i} of a text" for i in range(120))
    near = text.replace("word60 ", "other ")
    docs = spark.createDataFrame([(5, near, "en", "a", 1), (3, text, "en", "a", 1), (9, text, "en", "b", 1), (7, "something else " + text[::-1], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [3, 7]


def test_each_row_is_taken_as_often_as_its_own_copies(spark):
    # ids are missing or shared: the mix of the same rows with ids of their own limits each row to 3 copies
    rows = [(None, f"null{i} " * (40 + i), "en", "ab"[i % 2], i) for i in range(30)] + [(7, f"seven{i} " * (50 + i), "en", "c", i) for i in range(6)] + [(i, f"own{i} " * 45, "en", "abc"[i % 3], i) for i in range(20, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter(r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert max(taken.values()) <= 3
    words, got, target = Counter(), Counter(), {}
    for r in mix(docs).collect():
        target[r.source] = r.target
    for _, text, _, source, _ in rows:
        words[source] = max(words[source], len(text.split()))
        got[source] += taken[text] * len(text.split())
    assert all(abs(got[s] - target[s]) <= words[s] for s in target)
