"""Order over a whole table without one task for it: rows sorted in ranges, and what the ranges have added up."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def in_ranges(rows: DataFrame, *order: str | Column, most: int | None = None) -> DataFrame:
    """rows sorted in ranges and written, with `_id` (rises in this order) and `_range`. most: about how many rows a range has (else as shuffles are set)."""
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // most)), *order) if most else rows.repartitionByRange(*order)
    ranged = stored(dealt.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return ranged.withColumn("_range", F.shiftright("_id", 33))


def running(ranged: DataFrame, **sums: str) -> DataFrame:
    """Rows of in_ranges with running sums, over all rows up to each of them. sums: name=column."""
    inside = Window.partitionBy("_range").orderBy("_id")
    own = ranged.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    whole = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    out = own.join(F.broadcast(whole), F.col("_range") == F.col("_r"))
    return out.select(*ranged.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
