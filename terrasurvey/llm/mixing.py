"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table

#: A per-source table of at most this many rows may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Adds `target` to (source, source_size): shares of the whole by weight, stopped at max_repeat times a source's size.

    The weights go round the sources by code point, null last. What a stopped source leaves is shared by weight among
    the others until none is above its stop: sorted by stop / weight, the stopped sources are a prefix, and the
    level (words per unit of weight) of the first source that is not stopped holds for all after it.
    """
    by_name, by_stop = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_fills_at", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    i = (F.row_number().over(by_name) - 1) % len(weights)
    t = per_source.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), i + 1).cast("long"))
    t = t.withColumn("_stop", F.col("source_size") * max_repeat).withColumn("_fills_at", F.col("_stop") / F.col("_w"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_stop").over(before), F.lit(0))
    t = t.withColumn("_level", left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    t = t.withColumn("_at", F.row_number().over(by_stop))
    t = t.withColumn("_open", F.col("_stop") > F.col("_level") * F.col("_w"))
    first = F.min(F.when(F.col("_open"), F.struct("_at", "_level"))).over(whole)
    t = t.withColumn("_first", first)
    target = F.when(F.col("_at") >= F.col("_first._at"), F.col("_first._level") * F.col("_w")).otherwise(F.col("_stop").cast("double"))
    return t.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), *[c for c in per_source.columns if c not in ("source", "source_size")])


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone, the same in every run."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, buckets: int = 4096, row: str | None = None) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, copies, taken).

    A source whose target is r times its size gives floor(r) whole copies of every document for certain. The rest of the
    target is one more copy of some: an order sample without replacement in which a document's inclusion
    probability is in proportion to the root of its size (at most 1), so that long documents come first but do not crowd out
    the others. Documents are ranked by the odds of a uniform number over the odds of inclusion, and taken
    in this order while that brings the source's words nearer to its target; where that stops short, the one document of the
    size nearest to the gap is added. Ranks are found without sorting a source: the rank key
    falls into `buckets` ranges, sums by range show the one range in which the target is met, and only that is sorted.

    Null text has size 0; null sources form one source; documents of size 0 take 0; an empty table gives no rows;
    equal ids share one random number and are ordered by size; columns other than doc_id, text and source don't matter.
    A column that tells rows apart (`row`) is carried along, so that rows of equal ids can be told apart; it orders rows of equal id and size.
    """
    rows = [row] if row else []
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *rows))
    # sums of integers only: the same in every run, whatever the order
    sized = sized.withColumn("_root", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_root") * F.col("size")).alias("_root_size"))
    per_source = stored(source_targets(per_source, weights, max_repeat))
    small = per_source.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)

    t = per_source.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size"))
    t = t.withColumn("_rate", F.when(F.col("_root_size") > 0, F.col("_rest") / F.col("_root_size")).otherwise(F.lit(0.0))).withColumnRenamed("source", "_source")
    ranked = sized.join(hint(t), F.col("source").eqNullSafe(F.col("_source")))
    p = F.greatest(F.least(F.col("_rate") * F.col("_root"), F.lit(1 - 1e-9)), F.lit(1e-12))
    u = uniform(F.col("doc_id"))
    ranked = ranked.withColumn("_p", p).withColumn("_u", u)
    odds = (F.col("_u") * (1 - F.col("_p"))) / ((1 - F.col("_u")) * F.col("_p"))
    ranked = ranked.withColumn("_odds", odds).withColumn("_key", F.col("_odds") / (1 + F.col("_odds"))).withColumn("_range", F.floor(F.col("_key") * buckets).cast("int"))

    by_range = ranked.groupBy("source", "_range").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    to_here = Window.partitionBy("source").orderBy("_range")
    by_range = by_range.withColumn("_to", F.sum("_words").over(to_here))
    # the range in which the rest of the target is met; none where the rest is more than all words, or nothing is left to take
    met = by_range.where((F.col("_rest") > 0) & (F.col("_to") > F.col("_rest"))).groupBy("source").agg(F.min(F.struct("_range", (F.col("_to") - F.col("_words")).alias("_before"))).alias("_met"))
    met = met.select(F.col("source").alias("_met_source"), F.col("_met._range").alias("_met_range"), F.col("_met._before").alias("_before"))
    ranked = ranked.join(hint(met), F.col("source").eqNullSafe(F.col("_met_source")), "left")

    apart = ranked.where(~F.coalesce(F.col("_range") == F.col("_met_range"), F.lit(False)))
    apart = apart.withColumn("_extra", F.when((F.col("_rest") > 0) & F.coalesce(F.col("_range") < F.col("_met_range"), F.lit(True)), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size", *rows).rowsBetween(Window.unboundedPreceding, -1)
    near = ranked.where(F.col("_range") == F.col("_met_range"))
    so_far = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    near = near.withColumn("_extra", F.when(so_far + F.col("size") / 2 <= F.col("_rest"), 1).otherwise(0))
    kept = ["doc_id", "source", "size", "source_size", "target", "copies", "_rest", "_extra", *rows]
    both = stored(apart.select(*kept).unionByName(near.select(*kept)))
    # one more document where a source stops short of its target before a long one: that of the size nearest to the gap
    gap = both.groupBy("source").agg((F.first("_rest") - F.sum(F.col("size") * F.col("_extra"))).alias("_gap")).where(F.col("_gap") > 0)
    off = F.abs(F.col("size") - F.col("_gap"))
    found = both.where(F.col("_extra") == 0).join(hint(gap.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).where(off < F.col("_gap"))
    found = found.groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id", "size", *rows)).alias("_one"))
    found = found.select(F.col("source").alias("_one_source"), F.col("_one.doc_id").alias("_one_id"), F.col("_one.size").alias("_one_size"), *[F.col("_one").getField(c).alias("_one_row") for c in rows])
    both = both.join(hint(found), F.col("source").eqNullSafe(F.col("_one_source")), "left")
    is_one = F.col("doc_id").eqNullSafe(F.col("_one_id")) & (F.col("size") == F.col("_one_size"))
    for c in rows:
        is_one &= F.col(c) == F.col("_one_row")
    added = F.when(is_one & (F.col("_extra") == 0), 1).otherwise(0)
    # where the certain copies are max_repeat already, nothing is left to add
    copies = F.least(F.col("copies") + F.col("_extra") + added, F.lit(max_repeat))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *rows)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), rooted AS (
  SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS root,
         (CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(root * size) AS BIGINT) AS root_size FROM rooted GROUP BY source
), weighted AS (
  SELECT *, 3 * source_size AS stop,
         1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w
  FROM per_source
), shares AS (
  SELECT *, (SELECT sum(source_size) FROM weighted) AS total FROM weighted
), rounds(n, source, w, stop, source_size, root_size, done) AS (
  SELECT 0, source, w, stop, source_size, root_size, FALSE FROM shares
  UNION ALL
  SELECT n + 1, source, w, stop, source_size, root_size, done OR stop <= level * w
  FROM (SELECT *, CAST(sum(source_size) OVER () - COALESCE(sum(stop) FILTER (WHERE done) OVER (), 0) AS DOUBLE)
                  / CAST(sum(w) FILTER (WHERE NOT done) OVER () AS DOUBLE) AS level,
               bool_or(NOT done) OVER () AS going FROM rounds)
  WHERE going AND n < 40
), settled AS (
  SELECT *, CAST(sum(source_size) OVER () - COALESCE(sum(stop) FILTER (WHERE done) OVER (), 0) AS DOUBLE)
            / CAST(sum(w) FILTER (WHERE NOT done) OVER () AS DOUBLE) AS level
  FROM rounds WHERE n = (SELECT max(n) FROM rounds)
), targets AS (
  SELECT *, CASE WHEN done THEN CAST(stop AS DOUBLE) ELSE level * w END AS target FROM settled
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets
), odds AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, t.copies, t.target - t.copies * t.source_size AS rest, r.u,
         greatest(least(CASE WHEN t.root_size > 0 THEN (t.target - t.copies * t.source_size) / t.root_size ELSE 0.0::DOUBLE END * r.root,
                        1 - 1e-9::DOUBLE), 1e-12::DOUBLE) AS p
  FROM rooted r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source
), keyed AS (
  SELECT *, ((u * (1 - p)) / ((1 - u) * p)) / (1 + (u * (1 - p)) / ((1 - u) * p)) AS k FROM odds
), taken AS (
  SELECT *, COALESCE(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed
), extra AS (
  SELECT *, CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS more FROM taken
), gaps AS (
  SELECT *, rest - sum(size * more) OVER (PARTITION BY source) AS gap FROM extra
), nearest AS (
  SELECT *, rank() OVER (PARTITION BY source, more = 0 AND abs(size - gap) < gap ORDER BY abs(size - gap), doc_id, size) AS place FROM gaps
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(copies + more + CASE WHEN more = 0 AND abs(size - gap) < gap AND place = 1 THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM nearest
"""
