"""Connected components of links between long ids, on DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that (a, b) links: root is the smallest node that can be reached.

    Alternates large stars (each node's larger neighbours move to its smallest neighbour) and small stars (its smaller ones do) until nothing
    changes; each round's links are written to the shared folder. A node with very many links is only ever grouped by a minimum, which is
    taken before the shuffle, and joined, where Spark splits large keys.
    """
    ends = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        ends = stored(small.where("a != b").distinct())
        now = ends.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return ends.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
