import random
import re
import time
from html import unescape

from terrasurvey.llm import html
from terrasurvey.llm.html import common, extract, lines_of, op3_html


def test_query_equals_the_article_of_each_page(spark):
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        blocks = re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want[r.page_id] = "\n".join(x for b in blocks if (x := " ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())))
    rows = op3_html(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body><header>H</header><div class="main nav">N</div><p>one&nbsp;&amp; <i>two</i><br>three
    <p>four<script>var x = "</p>";</script> five<ul><li>six<li>seven</ul><div id='comments'><div>no</div>no</div><form>no</form>
    <div class="loaded header2">eight &#233;&lt;b&gt;</div><!-- no <p> --><footer>F</footer><div hidden>no</div><p role="alert">no"""
    assert [x for x, place in lines_of(page) if place] == ["one & two three", "four five", "six", "seven", "eight é<b>"]
    assert lines_of(None) == lines_of("") == [] and lines_of("a < b") == [("a < b", 1)]
    assert lines_of("<main>x<aside>y</aside></main>z") == [("x", 2), ("y", 0), ("z", 1)]


def test_common_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(2)
    for turn in range(400):
        a, b = ([rng.randint(0, rng.choice([2, 12])) for _ in range(rng.randint(0, 12))] for _ in range(2))
        monkeypatch.setattr(html, "BITS", turn % 2 * 1000)  # with and without halving
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p < q and r < t for (p, r), (q, t) in zip(got, got[1:]))
    assert len(common([1, 2, 1], [2, 1])) == 2


def texts_of(spark, rows):
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_what_differs_decides_not_the_markup(spark):
    # one line that all pages have and one of their own: a template that is half of each page
    rows = [(i, f"http://a.example/{i:02d}/story", f"<body><p>All rights and every menu of this site<p>Own story number {i}</body>") for i in range(60)]
    # copies with small changes in a long row, each alone in its folder; their template is unmarked
    rows += [(100 + i, f"http://b.example/{i:02d}/x", f"<div>Menu of b</div><div>the same long story told on many pages</div><div>told at {i} o'clock</div>") for i in range(20)]
    rows += [(200 + i, f"http://b.example/9{i:02d}/x", f"<div>Menu of b</div><div>quite another story {i} that stands alone</div>") for i in range(30)]
    texts = texts_of(spark, rows)
    assert all(texts[i] == f"Own story number {i}" for i in range(60))
    assert all(texts[100 + i] == f"the same long story told on many pages\ntold at {i} o'clock" for i in range(20))
    assert all(texts[200 + i] == f"quite another story {i} that stands alone" for i in range(30))


def test_names_that_only_hold_a_word_lose_nothing(spark):
    rows = [
        (1, "http://a.example/", '<div class="layout has-sidebar"><article><header>Site<h2>Title</h2>by me</header><p>the text</article></div>'),
        (2, "http://b.example/", '<section id="legal-analysis"><p>the analysis</section>'),
        (3, "http://c.example/", '<body class="page-sidebar comments-open"><div class="has-sidebar no_ads is-nav-open notices-count"><p>the body</div>'),
        (4, "http://d.example/", "<p>text</ p><p>more</><a href='x>y'>link</a> <b title=it's>bold</b></p>"),
    ]
    assert texts_of(spark, rows) == {1: "Title\nthe text", 2: "the analysis", 3: "the body", 4: "text\nmorelink bold"}


def test_time_is_linear_in_odd_pages():
    for odd in ("<a b ", "<a b='", '<a b="', "<!-- ", "<div>", "</x>", "<div></b>", "<p class=", "&amp", "<script>", "<b><i>x</b>", "<", "</"):
        page = "start" + odd * (400_000 // len(odd))
        began = time.process_time()
        lines_of(page)
        assert time.process_time() - began < 5


def test_a_page_of_many_lines_is_compared_whole(spark):
    long = "".join(f"<p>line {i}" for i in range(20_000))
    rows = [(1, "http://a.example/1", "<p>menu" + long), (2, "http://a.example/2", "<p>menu<p>short"), (3, "http://a.example/3", "<p>menu<p>other")]
    texts = texts_of(spark, rows)
    assert texts[1].startswith("line 0\n") and texts[1].endswith("line 19999") and texts[2] == "short"


def test_lines_shared_with_the_nearest_url_go(spark):
    def page(i, n):
        return f"<body><p>Welcome to our site<p>Story {i} begins" + "".join(f"<p>text {i} {k}" for k in range(n)) + "<p>All about us</body>"

    rows = [(i, f"http://a.example/x/{i:04d}", page(i, 4)) for i in range(40)]
    rows += [(100, "http://b.example/x/1", page(1, 4)), (101, "http://c.example/1", page(7, 3)), (102, "http://c.example/2", page(7, 3)), (103, None, None), (104, "http://c.example/3", ""), (104, "http://c.example/3", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for parts in (4, 23):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = extract(pages).collect()
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(got) == len(rows) and set(extract(pages).columns) == {"page_id", "url", "text"}
        texts = {r.page_id: r.text for r in got}
        for i in range(40):
            assert texts[i].startswith(f"Story {i} begins\ntext {i} 0") and "Welcome" not in texts[i] and "about us" not in texts[i]
        # alone on its host, or beside a copy only: nothing to compare with
        assert texts[100].startswith("Welcome") and texts[101] == texts[102] and texts[101].startswith("Welcome")
        assert texts[103] == texts[104] == ""
    assert extract(pages.limit(0)).count() == 0


def test_lines_inside_an_article_need_two_other_pages(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>Subscribe now<p>story {i}<p>more {i}<p>end {i}" + ("<p>quoted" if i in (2, 3) else "") + "</article>") for i in range(1, 6)]
    texts = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts[2] == "story 2\nmore 2\nend 2\nquoted" and texts[3].endswith("quoted")
    # the first and the last page are held against the nearest two on their one side
    assert all(texts[i].startswith(f"story {i}") for i in range(1, 6))
    pages = [(i, f"http://{host}.example/{i:02d}", f"<article><p>Subscribe now<p>a story {i}<p>and its end {i}</article>") for host, among in (("a", (1, 2)), ("b", (3, 4, 5)), ("c", (6,))) for i in among]
    # copies at the end of a host: all of them are held against the pages before their run
    pages += [(i, f"http://d.example/{i:02d}", f"<article><p>Subscribe now<p>a story {i}<p>and its end {i}</article>") for i in range(10, 30)]
    pages += [(i, f"http://d.example/{i:02d}", f"<article><p>Subscribe now<p>the story that was told very often<p>told at {i}</article>") for i in range(30, 40)]
    texts = texts_of(spark, pages)
    assert all(texts[i] == "Subscribe now\na story %d\nand its end %d" % (i, i) for i in (1, 2, 6))  # two pages don't tell a template from a quotation
    assert all(texts[i] == f"a story {i}\nand its end {i}" for i in (3, 4, 5, *range(10, 30)))
    assert all(texts[i] == f"the story that was told very often\ntold at {i}" for i in range(30, 40))


def test_main_text_does_not_hang_on_lengths(spark):
    comment = "<p>a reader says that this was a story to be remembered for years"
    rows = []
    for i, n in enumerate((0, 1, 9, 300)):
        rows.append((i, f"http://a{i}.example/", f'<div class="site-header">Site</div><article><p>short story</article><div class="comment-list">{comment * n}</div><div id="cookie-banner">We use</div>'))
        rows.append((10 + i, f"http://b{i}.example/", f"<div>Site</div><article><p>short story</article><div class=x>{comment * n}</div>"))
        rows.append((20 + i, f"http://c{i}.example/", f'<div><p>short story</div><section class="comment_list">{comment * n}</section><div class="sidebar-left">more</div><div class="ad-slot">buy</div>'))
    assert set(texts_of(spark, rows).values()) == {"short story"}


def test_differencing_carries_pages_without_names(spark, monkeypatch):
    """Class names emptied and no article elements: what the pages of a host share goes, their own lines stay."""
    monkeypatch.setattr(html, "PARTS", frozenset())
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(7))
    rows, want = [], {}
    for host in range(4):
        top, end = [[" ".join(word() for _ in range(5)) for _ in range(6)] for _ in range(2)]
        for i in range(15):
            own = [" ".join(word() for _ in range(12)) for _ in range(rng.choice([2, 10, 40]))]
            block = lambda lines: "".join(f"<div class='comments'><p>{x}</p></div>" for x in lines)
            rows.append((host * 100 + i, f"https://h{host}.example/s/{i:03d}", f"<body>{block(top)}{block(own)}{block(end)}</body>"))
            want[host * 100 + i] = "\n".join(own)
    assert texts_of(spark, rows) == want
