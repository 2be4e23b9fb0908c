"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasurvey.llm.common import fresh, stored, table
from terrasurvey.llm.lines import dedup_lines
from terrasurvey.llm.mixing import mix
from terrasurvey.llm.packing import pack
from terrasurvey.llm.quality import keep
from terrasurvey.llm.shingles import near_copies


def folded(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage works with; all others, whatever their names, in a struct `rest`."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unfolded(rows: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c) if c in own else F.col("rest").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the cascade of quality rules, each judged by itself.

    Null, empty and blank texts have no words and go; null ids, repeated rows, ties and further columns change nothing; very long texts are
    judged whole; an empty table stays empty.
    """
    return keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; documents of which nothing is left go. n_chars follows the text.

    Documents count in the order of their ids, null ids first. Rows of equal id and text are one document and get equal texts; different texts of one id
    count in the order of a hash. Null and blank texts stay; very long texts are compared whole; further columns stay; an empty table stays empty.
    """
    rows = dedup_lines(folded(docs, "doc_id", "text", "n_chars")).where("n_removed = 0 or n_removed < n_lines")
    kind = docs.schema["n_chars"].dataType
    return unfolded(rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))), docs, "doc_id", "text", "n_chars")


def with_row(docs: DataFrame, *own: str) -> DataFrame:
    """docs, folded, written with a key `_row` that no two rows share: ids may be missing or shared. Its hash orders rows the same in every run."""
    row = F.struct(F.xxhash64(*docs.columns).alias("hash"), F.monotonically_increasing_id().alias("n"))
    (key,) = fresh(docs.columns, "_row")
    others = [c for c in docs.columns if c not in own]
    keyed = docs.withColumn(key, row)
    return stored(keyed.select(*own, (F.struct(*others) if others else F.lit(0)).alias("rest"), F.col(key).alias("_row")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, a similarity of 0.8 or more): that with the smallest doc_id.

    Rows without an id come after those with one; of rows of one id, or without, the one with the smallest hash stays. Different texts of one id
    stay both, unless they are near copies. Null, empty and blank texts are copies of each other; very long texts are compared whole; further
    columns stay; an empty table stays empty. Links within 4 bits are found by SimHash, by bit counts of segments on a grid, and checked exactly; short
    texts at 0.8 differ in up to 13 bits, and those that SimHash leaves apart are found by min-hash bands (see near_copies).
    """
    rows = with_row(docs, "doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    grouped = rows.select("doc_id", "_row").join(near_copies(rows, "_row", shingle=5, least=0.8), "_row")
    first = grouped.groupBy("_root").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = grouped.join(first, "_root").where(F.col("_row") != F.col("_first._row")).select("_row")
    return unfolded(rows.join(later, "_row", "left_anti"), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 times. Each row has its own number of copies, also if ids are missing or shared.

    Null sources are one source; null and blank texts have size 0, so that they neither count nor matter; equal ids share one random number, and ties
    go by size and a hash of the row; very long texts count whole; further columns stay; an empty table stays empty.
    """
    rows = with_row(docs, "doc_id", "text", "source")
    taken = rows.join(mix(rows, row="_row").where("copies > 0").select("_row", "copies"), "_row")
    return unfolded(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, "doc_id", "text", "source")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens.

    Null and empty texts are one piece with the end alone; very long texts are many pieces; rows are packed as often as they occur, whatever their ids;
    further columns don't matter; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints by XXH64 and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
