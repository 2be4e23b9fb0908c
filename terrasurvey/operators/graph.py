"""Connected components of links by star contraction, with each round's links written and read again."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, stored

#: Links that a task contracts at once.
CHUNK = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of links between longs: for each node but the roots the smallest node that these links lead to.

    Roots hook onto smaller roots, and every node then points to its root's root until nothing changes; both halve what is left.
    """
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        low, high = np.minimum(rx, ry)[open_], np.maximum(rx, ry)[open_]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def locally_contracted(links: DataFrame) -> DataFrame:
    """(a, b) with the same components: the links of each partition become stars around their smallest nodes."""

    def run(batches):
        held, n = [], 0

        def stars():
            a, b = contracted(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= CHUNK:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def is_settled(ends: DataFrame) -> bool:
    """Whether each node has one link, to a node without a link of its own."""
    sides = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("own")), F.struct(F.col("b").alias("node"), F.lit(0).alias("own")))).alias("s"))
    nodes = sides.groupBy("s.node").agg(F.sum("s.own").alias("own"), F.min("s.own").alias("least"))
    return nodes.where("own > 1 or own = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that links (a, b), both long, name: root is the smallest node that can be reached.

    In each round the tasks contract the links they have; then each node's larger neighbours move to its smallest neighbour (large star), and
    its smaller ones do (small star), until all links are stars. Neighbours are only grouped by a minimum, taken before the shuffle, and joined, where
    Spark splits large keys. A round's links are written to the shared folder and the former round's deleted, so neither the plan nor its size
    estimate grows. The number of rounds follows the logarithm of the longest path, and has no limit. Links of a node with itself keep the node.
    """
    own = links.select(F.col("a").cast("long").alias("node")).union(links.select(F.col("b").cast("long")))
    ends = stored(locally_contracted(links.where("a != b")))
    while not is_settled(ends):
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        before, ends = ends, stored(locally_contracted(small.where("a != b")))
        forget(before)
    return own.distinct().join(ends.withColumnRenamed("a", "node").withColumnRenamed("b", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
