"""Quality rules as a short-circuit cascade, ordered on a sample by rejection per cost."""

import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

SYMBOLS = b"#*$%&|<>"


class Text:
    """A text with the counts that rules share. Words are runs of anything but ASCII white space."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.words = self.raw.split()
        self.n = len(self.words)

    def word_chars(self) -> int:
        return len(b"".join(self.words).decode(errors="replace"))

    def symbols(self) -> int:
        return sum(self.raw.count(bytes([c])) for c in SYMBOLS)

    def dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.split()]
        return len(lines) - len(set(lines))

    def lines(self) -> int:
        return sum(1 for x in self.raw.split(b"\n") if x.split())

    def repeat_words(self) -> int:
        """Words in 3-word windows found twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often, n, to = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                n += i + 3 - max(i, to)
                to = i + 3
        return n


def rule_symbols(t: Text) -> bool:
    return 10 * t.symbols() > t.n


def rule_letters(t: Text) -> bool:
    """Over a quarter of the words have no letter."""
    return 4 * sum(1 for w in t.words if not (w.isalpha() or any(c.isalpha() for c in w.decode(errors="replace")))) > t.n


def rule_capitals(t: Text) -> bool:
    """Over half of the words are in capitals, in a text long enough to tell."""
    return 2 * sum(1 for w in t.words if w.isupper() and len(w) > 1) > t.n


def rule_word_length(t: Text) -> bool:
    return not 2 * t.n <= t.word_chars() <= 15 * t.n


def rule_dup_lines(t: Text) -> bool:
    return 2 * t.dup_lines() > t.lines() > 3


def rule_top_word(t: Text) -> bool:
    """One word makes up over 30 % of the text."""
    return 10 * Counter(t.words).most_common(1)[0][1] > 3 * t.n


#: Each says of a text with at least one word whether it is to be rejected.
RULES: dict[str, Callable[[Text], bool]] = {"symbols": rule_symbols, "letters": rule_letters, "capitals": rule_capitals, "word_length": rule_word_length, "dup_lines": rule_dup_lines, "top_word": rule_top_word}


def cascade(docs: DataFrame, rules: dict[str, Callable[[Text], bool]], sample_rows: int = 2000) -> list[str]:
    """The rules' names in the order to try them: always the one that rejects most of what is left of the sample per second it takes.

    The sample holds about sample_rows documents, chosen by a hash of doc_id (at most four times as many). The order
    decides what the cascade costs, never which documents are kept.
    """
    every = max(1, docs.count() // sample_rows)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(4 * sample_rows)

    def tried(batches):
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                t, row = Text(raw), []
                if t.n:
                    for rule in rules.values():
                        began = time.perf_counter()
                        row.append({"no": rule(t), "s": time.perf_counter() - began})
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.struct([("no", pa.bool_()), ("s", pa.float64())])))], ["rules"])

    rows = [r["rules"] for r in some.select(F.col("text").cast("binary")).mapInArrow(tried, "rules array<struct<no:boolean,s:double>>").collect()]
    names, left = list(rules), list(range(len(rules)))
    order: list[str] = []
    while left:
        rate = {k: sum(r[k]["no"] for r in rows) / max(sum(r[k]["s"] for r in rows), 1e-9) for k in left}
        best = max(left, key=lambda k: (rate[k], -k))
        order.append(names[best])
        left.remove(best)
        rows = [r for r in rows if not r[best]["no"]]
    return order


def judge(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) of every text.

    Base: fewer than 50 words, or over half of them in repeated 3-word windows. What passes goes through the cascade, which stops at the
    first rule that rejects it; rejected_by names it ('base' for the base, null if kept).

    Null and blank texts have no words and fail the base; a very long text is judged whole; bytes that are no UTF-8 count as one character each; equal rows get equal rows; an empty
    table gives no rows; columns other than doc_id and text don't matter.
    """
    rules = rules or RULES
    order = [(name, rules[name]) for name in cascade(docs, rules, sample_rows)]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            names, out = batch.column(0), []
            for raw in batch.column(1).to_pylist():
                t = Text(raw)
                repeats = t.repeat_words()
                failed = t.n < 50 or 100 * repeats > 50 * t.n
                by = "base" if failed else next((name for name, rule in order if rule(t)), None)
                out.append((t.n, t.word_chars(), t.symbols(), t.dup_lines(), repeats, failed, by is None, by))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([names, *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    fields = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, fields)


def keep(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The documents that pass base and cascade, with all their columns, whatever their names; odd rows as in judge()."""
    rules = rules or RULES
    order = [rules[name] for name in cascade(docs, rules, sample_rows)]
    columns = docs.columns

    def run(batches):
        for batch in batches:
            kept = []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                t = Text(raw)
                kept.append(t.n >= 50 and not any(rule(t) for rule in order) and 100 * t.repeat_words() <= 50 * t.n)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], columns).filter(pa.array(kept, pa.bool_()))

    (raw,) = fresh(docs.columns, "raw")
    return docs.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")
