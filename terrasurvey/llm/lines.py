"""Line dedup by winnowing: later repeats of runs of lines are deleted."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from .common import fresh, spread_join, stored, table

SPACE = b" \t\n\r\x0b\x0c"


def windows(text: bytes, min_words: int) -> list[tuple[int, int, list[bytes], int]]:
    """(first line, last line, lines, fingerprint) of every window of a text.

    Lines without a word don't count. A window is the shortest run of lines from its first that holds min_words words, or the shortest such
    run up to its last; a text of fewer words is one window. The window's fingerprint is the least of its lines' hashes.
    """
    lines = [(i, x.strip(SPACE), n) for i, x in enumerate(text.split(b"\n")) if (n := len(x.split()))]
    hashes = [xxh64_intdigest(x) - (1 << 63) for _, x, _ in lines]
    spans, end, words = set(), 0, 0
    for start in range(len(lines)):
        while words < min_words and end < len(lines):
            words += lines[end][2]
            end += 1
        if words < min_words:
            if not start:
                spans.add((start, end))
            break
        spans.add((start, end))
        words -= lines[start][2]
    start, words = 0, 0
    for end in range(1, len(lines) + 1):
        words += lines[end - 1][2]
        while words - lines[start][2] >= min_words:
            words -= lines[start][2]
            start += 1
        if words >= min_words:
            spans.add((start, end))
    return [(lines[a][0], lines[b - 1][0], [x for _, x, _ in lines[a:b]], min(hashes[a:b])) for a, b in sorted(spans)]


def repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, runs): for each document with repeats, the first and last lines of windows that also stand at an earlier place."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            who, first, last, prints, keys = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for a, b, lines, least in windows(text or b"", min_words):
                    who.append(i)
                    first.append(a)
                    last.append(b)
                    prints.append(least)
                    keys.append(hashlib.blake2b(b"\n".join(lines), digest_size=16).digest())
            rows = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(prints, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "text_hash", "first", "last", "print", "window"])

    fields = f"doc_id {kind}, text_hash long, first int, last int, print long, window binary"
    all_windows = stored(docs.select("doc_id", "text_hash", F.col("text").cast("binary")).mapInArrow(cut, fields))
    # fingerprints at one place only cannot belong to a repeat; the positions of the others meet
    often = all_windows.groupBy("print").agg(F.count("*").alias("often")).where("often > 1")
    met = spread_join(all_windows, often, "print", "often", all_windows.count()).select("window", F.struct("doc_id", "text_hash", "first").alias("place"), "last")
    # a match at a fingerprint is extended over the lines before and behind it: the earliest place at which all lines of a window agree
    earliest = met.groupBy("window").agg(F.min("place").alias("earliest"), F.count("*").alias("often")).where("often > 1")
    later = spread_join(met, earliest, "window", "often", all_windows.count()).where(F.col("place") != F.col("earliest"))
    # windows that overlap or touch make up the longest match
    return later.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash")).agg(F.sort_array(F.collect_list(F.struct(F.col("place.first").alias("first"), "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """docs without later repeats of runs of lines; adds n_lines and n_removed (lines with a word before, and deleted).

    A run of lines that holds at least min_words words is a repeat if the same lines stand at an earlier place: in a document with a
    smaller doc_id, or further up in the same one. All lines of all such runs go. Winnowing finds them: each window of lines selects the least of
    its line hashes as its fingerprint, and equal windows select equal fingerprints, so only positions whose fingerprint occurs elsewhere meet.
    A match is extended both ways from the fingerprint by the windows that hold it, from their first line on and up to their last one: every
    line of a longest match lies in such a window that is part of the match, and none beyond it does. Each window is compared with the earliest
    place of the same lines, so that thousands of copies give as many comparisons and no pairs. Very frequent fingerprints and windows are
    spread over tasks.

    Lines are compared without white space at their ends; lines without a word stay. Null text stays null, blank texts stay as they are; a
    very long text is compared whole; null doc_ids come first; rows with equal doc_id and text are one document and get equal results; an
    empty table gives no rows; other columns stay, whatever their names (n_lines and n_removed are replaced).
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*columns)
    runs = stored(repeated(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), min_words))
    doc, text_hash, found, own_hash = fresh(columns, "_doc", "_hash", "_runs", "_own_hash")
    runs = runs.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("runs").alias(found))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(text_hash))
    # merged, not broadcast: how many documents have repeats grows with the table
    joined = docs.withColumn(own_hash, F.xxhash64("text")).join(runs.hint("merge"), same, "left").drop(doc, text_hash, own_hash)
    at = columns.index("text")

    def delete(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                full = [bool(x.strip(" \t\r\x0b\x0c")) for x in lines]
                gone: set[int] = set()
                for s in spans or ():
                    gone.update(i for i in range(s["first"], s["last"] + 1) if full[i])
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                counts.append(sum(full))
                removed.append(len(gone))
            parts = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*columns, "n_lines", "n_removed"])

    schema = StructType(docs.schema.fields).add("n_lines", "long").add("n_removed", "long")
    return joined.mapInArrow(delete, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), units AS (
  SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM cut)
), lines AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
         sum(words) OVER (PARTITION BY doc_id) AS whole, count(*) OVER (PARTITION BY doc_id) AS n
  FROM units WHERE words > 0
), spans AS (
  SELECT a.doc_id, a.k AS first, COALESCE(min(b.k), CASE WHEN a.k = 1 THEN any_value(a.n) END) AS last
  FROM lines a LEFT JOIN lines b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= 10
  GROUP BY a.doc_id, a.k
  UNION
  SELECT b.doc_id, max(a.k) AS first, b.k AS last
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.words >= 10
  GROUP BY b.doc_id, b.k
), windows AS (
  SELECT s.doc_id, s.first, s.last, string_agg(l.line, chr(10) ORDER BY l.k) AS content
  FROM spans s JOIN lines l ON s.doc_id = l.doc_id AND l.k BETWEEN s.first AND s.last WHERE s.last IS NOT NULL
  GROUP BY s.doc_id, s.first, s.last
), later AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS place FROM windows
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM later w JOIN lines l ON l.doc_id = w.doc_id AND l.k BETWEEN w.first AND w.last WHERE w.place > 1
), kept AS (
  SELECT p.doc_id, string_agg(p.x, chr(10) ORDER BY p.i) AS text
  FROM (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM cut) p
  LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id
), losses AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text,
       CAST(COALESCE(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(l.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id) LEFT JOIN losses l USING (doc_id)
"""
