"""Main text of web pages: markup that is never content goes, and lines shared with the pages of the nearest URLs go."""

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import spread_join, stored, table

# Element names of HTML, roles, and names that say by themselves that an element is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("textarea title xmp noembed noframes".split())
DROPPED = frozenset("head noscript template title nav footer aside form button select textarea datalist iframe object svg canvas audio video map dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("ad ads advert adverts advertisement sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments cookie cookies notice newsletter related share pagination".split())
# Words that make a name of several words a state or a layout of the content instead of such an element: has-sidebar, comments-open.
STATES = frozenset("has have with without no is not open opened closed enabled disabled active inactive status count hide show layout page wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Ranks of pages are followed in blocks of so many.
RANKS = 1 << 12
#: Matrices of aligned lines up to so many bits are kept whole.
BITS = 1 << 28

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORDS = re.compile(r"[^-_]+")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW | {"script", "style"}}


def is_part(attributes: str) -> bool:
    """Whether an element's attributes name it as something beside the content: its role, or a class or id.

    Of a class or id of several words (site-footer, comment_list) the first or the last has to say so, and none may say that it is a state or a layout.
    """
    if not attributes or attributes.isspace():
        return False
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        words = NAME_WORDS.findall(name)
        if words and not PARTS.isdisjoint((name, words[0], words[-1])) and STATES.isdisjoint(words):
            return True
    return False


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """(line, place) of a page, block by block: place is 2 in its article or main element, 1 elsewhere, 0 in elements that are never content.

    Time is linear in the page, whatever is left open: a tag, comment or script that never ends takes the rest of the page. Of the header of an
    article its headings are content.
    """
    html = html or ""
    out: list[tuple[str, int]] = []
    open_tags: list[tuple[str, str]] = []  # name, and what it does to the text in it
    names: Counter[str] = Counter()
    state = {"dropped": 0, "main": 0, "header": 0, "heading": 0, "": 0}
    words: list[str] = []
    at, n = 0, len(html)

    def end_block() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            seen = not state["dropped"] and (not state["header"] or state["heading"])
            out.append((text, (2 if state["main"] else 1) if seen else 0))

    while at < n:
        m = html.find("<", at)
        if m < 0:
            words.append(html[at:])
            break
        words.append(html[at:m])
        after = html[m + 1 : m + 2]
        letter = html[m + 2 : m + 3] if after == "/" else after
        if after in ("!", "?") or after == "/" and letter and not (letter.isascii() and letter.isalpha()):
            end = "-->" if html.startswith("<!--", m) else ">"
            close = html.find(end, m + 2)
            at = close + len(end) if close >= 0 else n
            continue
        if not (letter.isascii() and letter.isalpha()):
            words.append("<")
            at = m + 1
            continue
        tag = TAG.match(html, m)
        if not tag:
            break
        at, name = tag.end(), tag[2].lower()
        if name in ("script", "style"):  # leaves no trace, also within a block
            if not tag[1]:
                close = CLOSING[name].search(html, at)
                at = close.end() if close else n
            continue
        if name not in INLINE:
            end_block()
        elif name == "br":
            words.append(" ")
        if tag[1]:
            if names[name]:
                k = len(open_tags) - 1
                while open_tags[k][0] != name:
                    k -= 1
                if any(effect for _, effect in open_tags[k:]):
                    end_block()
                for other, effect in open_tags[k:]:
                    names[other] -= 1
                    state[effect] -= 1
                del open_tags[k:]
        elif name not in VOID and not tag[3].endswith("/"):
            effect = ""
            if name in ("article", "main"):
                effect = "main"
            if name in DROPPED or (name not in ("html", "body", "main") and is_part(tag[3])):
                effect = "dropped"
            elif name == "header":
                effect = "header" if state["main"] else "dropped"
            elif name in HEADINGS:
                effect = "heading"
            if effect:
                end_block()
            open_tags.append((name, effect))
            names[name] += 1
            state[effect] += 1
            if name in RAW:  # no markup inside
                close = CLOSING[name].search(html, at)
                at = close.start() if close else n
    end_block()
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of lines, as positions in both.

    Rows of the matrix of lengths are bit vectors (a zero where the length grows). Large matrices are halved first: the place in b at which the
    first half of a ends is where the lengths from both sides add up to the most.
    """
    both = set(a) & set(b)
    x, y = [i for i, v in enumerate(a) if v in both], [j for j, v in enumerate(b) if v in both]

    def rows(left: list[int], right: list[int]) -> list[int]:
        places: dict[int, int] = {}
        for j, v in enumerate(right):
            places[v] = places.get(v, 0) | 1 << j
        full, row, out = (1 << len(right)) - 1, (1 << len(right)) - 1, []
        for v in left:
            met = row & places.get(v, 0)
            row = ((row + met) | (row - met)) & full
            out.append(row)
            if len(left) * len(right) > BITS:
                out = out[-1:]
        return out

    def lengths(left: list[int], right: list[int]) -> list[int]:
        row, out = rows(left, right)[-1], [0]
        for bit in reversed(bin(row | 1 << len(right))[3:]):
            out.append(out[-1] + (bit == "0"))
        return out

    def align(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        if not x or not y:
            return []
        left, right = [a[i] for i in x], [b[j] for j in y]
        if len(x) * len(y) > BITS and len(x) > 1:
            half = len(x) // 2
            before, behind = lengths(left[:half], right), lengths(left[half:][::-1], right[::-1])
            cut = max(range(len(y) + 1), key=lambda j: before[j] + behind[len(y) - j])
            return align(x[:half], y[:cut]) + align(x[half:], y[cut:])
        if len(x) == 1:
            return [(x[0], y[right.index(left[0])])] if left[0] in right else []
        grown, out, i, j = rows(left, right), [], len(x), len(y)
        while i and j:
            if grown[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or grown[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((x[i], y[j]))
        return out[::-1]

    return align(x, y)


def are_copies(a: dict, b: dict) -> bool:
    """Whether half or more of the text of one page that is not common on the host is also on the other."""
    own = [{v: n for v, n, place, rare in zip(p["lines"], p["sizes"], p["places"], p["rare"], strict=True) if place and rare} for p in (a, b)]
    shared = sum(n for v, n in own[0].items() if v in own[1])
    return shared > 0 and 2 * shared >= min(sum(x.values()) for x in own)


def shared_lines(page: dict, back: dict | None, on: dict | None, further: dict | None) -> list[int]:
    """Positions of the lines that go: outside article and main those that the neighbour with the nearer URL has, inside those that both have
    and that are common on the host.

    further: where the host's first or last page has a neighbour on one side only, the next one on that side. An article is left whole if it would
    lose half of its text or more: a template is never most of an article.
    """
    sides = [x for x in (back, on, further) if x]
    if not sides:
        return []

    def alike(other: dict) -> int:
        p, q = page["path"], other["path"]
        return next((i for i, (c, d) in enumerate(zip(p, q, strict=False)) if c != d), min(len(p), len(q)))

    met = [{i for i, _ in common(page["lines"], x["lines"])} for x in sides]
    nearest = met[max(range(len(sides)), key=lambda k: (alike(sides[k]), -k))]
    both = {i for i in met[0] & met[1] if not page["rare"][i]} if len(met) == 2 else set()
    places, sizes = page["places"], page["sizes"]
    if 2 * sum(sizes[i] for i in both if places[i] == 2) >= sum(n for n, p in zip(sizes, places, strict=True) if p == 2):
        both = set()
    return [i for i, p in enumerate(places) if p and i in (both if p == 2 else nearest)]


def with_neighbours(pages: DataFrame) -> DataFrame:
    """(class, path, lines, places, sizes, rare, back, on, further): of the distinct pages, the two pages of the nearest URLs that are not copies of theirs.

    Pages are ranked by host and path: sorted in ranges, with the ranges' sizes added up. Pages next to each other that are copies make a
    run, and the neighbours of all pages of a run are the page before it and the page behind it, however long it is. If one of these is of
    another host, the next run on the other side gives the second (further). Nothing is gathered by host, and what is next to a page does
    not depend on how many pages there are.
    """
    first = pages.groupBy("class").agg(F.min(F.struct("path", "page")).alias("first"), F.first("host").alias("host"))
    order = ["host", "path", "class"]
    ranked = first.select("host", F.col("first.path").alias("path"), "class", F.col("first.page").alias("page")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = stored(ranked.withColumn("id", F.monotonically_increasing_id()).select("page", "id"))
    sizes = ranked.groupBy(F.shiftright("id", 33).alias("range")).agg(F.count("*").alias("n"))
    # a row for each range of the sort, of which there are as many as partitions
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    ranked = ranked.withColumn("range", F.shiftright("id", 33)).join(F.broadcast(before), "range")
    ranked = ranked.select("page", (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    distinct = stored(pages.dropDuplicates(["page"]).join(ranked, "page").drop("page"))
    n = distinct.count()

    hosts = distinct.groupBy("host").agg(F.count("*").alias("n"))
    own = F.array_distinct(F.transform(F.filter(F.arrays_zip("lines", "places"), lambda x: x["places"] > 0), lambda x: x["lines"]))
    often = distinct.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("often")).where("often >= 3")
    usual = spread_join(often, hosts, "host", "n", n).where("2 * often > n").groupBy("host").agg(F.collect_set("line").alias("usual"))
    hosts = hosts.join(usual, "host", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<long>")))
    asked = spread_join(distinct, hosts, "host", "n", n).select("rank", "host", "path", "class", "lines", "places", "sizes", "usual")

    def flagged(batches):
        for batch in batches:
            flags = [[x not in usual for x in lines] for lines, usual in zip(batch.column(4).to_pylist(), map(set, batch.column(7).to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(flags, pa.list_(pa.bool_()))], [*batch.schema.names[:7], "rare"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields[:7])
    known = stored(asked.mapInArrow(flagged, f"{kinds}, rare array<boolean>"))

    page = F.struct("host", "path", "lines", "places", "sizes", "rare")
    here, behind = known.select("rank", page.alias("a")), known.select((F.col("rank") - 1).alias("rank"), page.alias("b"))

    def copies(batches):
        for batch in batches:
            flags = [are_copies(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(flags, pa.bool_()))], ["rank"])

    joined = here.join(behind, "rank").where("a.host = b.host").select("rank", "a", "b").mapInArrow(copies, "rank long")
    ranks = known.select("rank").join(joined.select((F.col("rank") + 1).alias("rank"), F.lit(True).alias("copy")), "rank", "left")
    # where each run begins and the next one does: within blocks of ranks, then from block to block
    cut = F.when(F.col("copy").isNull(), F.col("rank"))
    ranks = stored(ranks.select("rank", F.floor(F.col("rank") / RANKS).alias("block"), cut.alias("cut")))
    blocks = ranks.groupBy("block").agg(F.min("cut").alias("low"), F.max("cut").alias("high"))
    in_order = Window.orderBy("block")  # a row for each block of RANKS pages
    blocks = blocks.select("block", F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("former"), F.min("low").over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    inside = Window.partitionBy("block").orderBy("rank")
    begin = F.max("cut").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    end = F.min("cut").over(inside.rowsBetween(1, Window.unboundedFollowing))
    runs = ranks.select("rank", "block", begin.alias("begin"), end.alias("end")).join(blocks, "block")
    runs = stored(runs.select("rank", F.coalesce("begin", "former").alias("begin"), F.coalesce("end", "next").alias("after")))
    # each run once, with the runs before and behind it, and what stands in for a neighbour of another host
    lengths = runs.groupBy("begin", "after").agg(F.count("*").alias("times"))
    each = stored(lengths.join(known.select(F.col("rank").alias("begin"), "host"), "begin"))
    former = each.select(F.col("after").alias("begin"), F.col("host").alias("former_host"), (F.col("begin") - 1).alias("former"))
    latter = each.select(F.col("begin").alias("after"), F.col("host").alias("latter_host"), F.col("after").alias("latter"))
    on_host = lambda c: F.coalesce(F.col(c) == F.col("host"), F.lit(False))
    stand_in = F.when(on_host("latter_host") & ~on_host("former_host"), F.col("latter")).when(on_host("former_host") & ~on_host("latter_host"), F.col("former"))
    each = each.join(former, "begin", "left").join(latter, "after", "left").select("begin", stand_in.alias("further"), "times")
    runs = spread_join(runs, each, "begin", "times", n).drop("times")
    # pages that need none ask for a rank that no page has, each for another one
    runs = stored(runs.select("rank", (F.col("begin") - 1).alias("before"), "after", F.coalesce("further", -2 - F.col("rank")).alias("further")))
    asked = known.join(runs, "rank")
    for side, name in (("before", "back"), ("after", "on"), ("further", "third")):
        times = runs.where(F.col(side) >= 0).groupBy(side).agg(F.count("*").alias("times"))
        other = known.select(F.col("rank").alias(side), F.struct("host", "path", "lines").alias(name)).join(times, side)
        asked = spread_join(asked, other, side, "times", n, "left").drop("times", side)
    same = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)).alias(side)
    return asked.select("class", "path", "lines", "places", "sizes", "rare", same("back"), same("on"), same("third").alias("further"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page: its lines, joined by line feeds.

    Pages are paired by URL path within each host: each page is compared with the nearest pages before and behind it in the order of paths that
    are not copies of it, the first and the last page of a host with the nearest two on their one side. Their lines (as hashes) are aligned by a longest common subsequence and shared lines are deleted, so that what a
    site repeats goes, whatever its markup. Two pages are copies if they share half or more of the text that is not common on the host
    (on three pages and over half of them); copies tell nothing about templates and are passed over. Elements that are never
    content by their name, role, or a class or id that is such a name as a whole are left out. If half or more of what is left lies in article or
    main elements, only that counts.

    Null html gives an empty text; a null or odd url is a host of its own kind; very long pages are read whole, in linear time; repeated rows are
    each other's copies and delete nothing; an empty table gives no rows; columns other than page_id, url and html don't matter.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    row = F.xxhash64("page_id", "url", "html")  # equal rows get equal texts, so that they may share a key

    def read(batches):
        for batch in batches:
            found = [lines_of(html) for html in batch.column(1).to_pylist()]
            hashes = pa.array([[hash_of(x) for x, _ in lines] for lines in found], pa.list_(pa.int64()))
            places = pa.array([[p for _, p in lines] for lines in found], pa.list_(pa.int32()))
            sizes = pa.array([[len(x) for x, _ in lines] for lines in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), hashes, places, sizes], ["page", "url", "lines", "places", "sizes"])

    hashed = keyed.select(row.alias("page"), "html", "url").mapInArrow(read, "page long, url string, lines array<long>, places array<int>, sizes array<int>")
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host, path = F.lower(F.substring_index(bare, "/", 1)), F.regexp_replace(bare, r"^[^/]*", "")
    hashed = stored(hashed.select("page", host.alias("host"), path.alias("path"), F.xxhash64(host, "lines", "places").alias("class"), "lines", "places", "sizes"))

    def compare(batches):
        for batch in batches:
            out = [shared_lines(r, r["back"], r["on"], r["further"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["class", "shared"])

    of_class = stored(with_neighbours(hashed).mapInArrow(compare, "class long, shared array<int>").where(F.size("shared") > 0))
    members = hashed.select("page", "class").distinct()
    times = members.groupBy("class").agg(F.count("*").alias("times"))
    shared = stored(spread_join(members, of_class.join(times, "class"), "class", "times", hashed.count()).select("page", "shared"))

    def write(batches):
        for batch in batches:
            out = []
            for html, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = set(gone or ())
                left = [(x, p) for i, (x, p) in enumerate(lines_of(html)) if p and i not in gone]
                least = max((p for _, p in left), default=0)
                out.append("\n".join(x for x, p in left if p == least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    with_shared = keyed.withColumn("page", row).join(shared, "page", "left")
    return with_shared.select("page_id", "url", "html", "shared").mapInArrow(write, f"page_id {kind}, url string, text string")


def hash_of(line: str) -> int:
    """A line's 64-bit hash."""
    return xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
