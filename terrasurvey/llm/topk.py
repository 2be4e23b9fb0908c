"""Exact top-k inner products by aggregation without random access over sorted lists."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table


#: The ends of the range of a score.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dims, vector): floor(scale * x) of each component as doubles, which hold these whole numbers exactly.

    Vectors null or with null or non-finite components and rows without a vec_id are left out.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().to_numpy()
            most = np.finfo(float).max
            whole = np.clip(np.floor(column.flatten().to_numpy() * scale), -most, most) + 0.0
            ends = np.cumsum(sizes)
            rows = [whole[b - n : b].tobytes() for b, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(rows, pa.binary())], ["vec_id", "dims", "vector"])

    return vectors.where(sound).select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"vec_id {kind}, dims int, vector binary").distinct()


#: Of the lists, so many parts of 8 are read to their end for all queries together: those that tell most about a query's scores.
HEAVY = 5


class SortedLists:
    """A shard's rows as one list for each dimension, sorted by this component; an entry has the row and its component.

    Beside the entries a row's squared length is known when the row is first seen.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.whole = ids, vectors
        self.n, self.d = vectors.shape
        # bounds are worked out on numbers of at most 1, so that no sum is too large
        shift = int(np.frexp(np.abs(vectors).max(initial=0))[1])
        self.small = np.ldexp(vectors, -shift)
        falling = np.argsort(-self.small, axis=0, kind="stable")
        self.values = np.take_along_axis(self.small, falling, axis=0).T.copy()
        self.rank = np.empty((self.d, self.n), np.int32)
        np.put_along_axis(self.rank, falling.T, np.arange(self.n, dtype=np.int32)[None, :], axis=1)
        self.parts = self.small**2
        self.squares = self.parts.sum(axis=1)

    def search(self, query_id, query: np.ndarray, k: int, few: int = 64) -> tuple[list[tuple], int]:
        """searches() of one query."""
        return next(self.searches(np.array([query_id]), query[None, :], k, few))

    def searches(self, query_ids: np.ndarray, queries: np.ndarray, k: int, few: int = 64):
        """For each query [(candidate, score)] of the k best rows but the query's own, ties by the smaller id, and the entries read.

        A row's score lies around the sum of what was read of it, by at most the product of the lengths of the query's and the row's parts
        not read yet. The lists that weigh most for a query (its component times how far the list's ends differ) are read to their ends
        first, for many queries at once by a product of matrices; rows with an upper bound below the k-th best lower bound are out. See narrowed
        for the others. What is left can qualify, and its scores are resolved exactly.
        """
        n, d = self.n, self.d
        heavy = d * HEAVY // 8
        many = max(1, (1 << 21) // max(n, 1))
        for at in range(0, len(queries), many):
            some, names = queries[at : at + many], query_ids[at : at + many]
            scaled = np.ldexp(some, -np.frexp(np.abs(some).max(axis=1, initial=0))[1][:, None])
            if not n or not heavy or n <= few + k:
                for query_id, query in zip(names, some, strict=True):
                    yield self.best(np.flatnonzero(self.ids != query_id), query, k), 0
                continue
            weight = np.abs(scaled) * (self.values[:, 0] - self.values[:, -1])
            mask = np.zeros(scaled.shape)
            np.put_along_axis(mask, np.argsort(-weight, axis=1, kind="stable")[:, :heavy], 1.0, axis=1)
            length = (scaled**2).sum(axis=1)
            total, read_q, read_v = (scaled * mask) @ self.small.T, (scaled**2 * mask).sum(axis=1), mask @ self.parts.T
            low, high = self.bounds(total, length[:, None], read_q[:, None], self.squares, read_v)
            low[names[:, None] == self.ids] = -np.inf
            kth = np.partition(low, n - min(k, n), axis=1)[:, n - min(k, n)]
            for i, (query_id, query) in enumerate(zip(names, some, strict=True)):
                may = np.flatnonzero((high[i] >= kth[i]) & (self.ids != query_id))
                may, read = self.narrowed(may, scaled[i], mask[i] == 0, total[i, may], read_q[i], read_v[i, may], length[i], k, few)
                yield self.best(may, query, k), heavy * n + read

    @staticmethod
    def bounds(total, length, read_q, squares, read_v) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that scores can be, by what was read: the sums, and the squares of the query's and the rows' parts."""
        rest_q, rest_v = np.maximum(length - read_q, 0) + 1e-13 * length, np.maximum(squares - read_v, 0) + 1e-13 * squares
        apart = np.sqrt(rest_q * rest_v) + 1e-9 * (np.sqrt(length * squares) + 1e-300)
        return total - apart, total + apart

    def narrowed(self, may, scaled, rest, total, read_q, read_v, length, k: int, few: int) -> tuple[np.ndarray, int]:
        """(rows of `may` that can still qualify, entries read): the other lists, read block after block, always the one whose unread entries may
        still differ most, from its top if the query's component is positive, else from its bottom, until all but a few rows are out."""
        n, block, read = self.n, max(64, -(-self.n // 4)), 0
        lists = np.flatnonzero(rest)
        x = scaled[lists]
        place, read_q = np.zeros(len(lists), np.int64), np.full(len(may), read_q)
        values = [self.values[j] if c >= 0 else self.values[j, ::-1] for j, c in zip(lists, x, strict=True)]
        front, back = np.array([c * v[0] for c, v in zip(x, values, strict=True)]), np.array([c * v[-1] for c, v in zip(x, values, strict=True)])
        while len(may) > few + k and (place < n).any():
            places = self.rank[np.ix_(lists, may)]
            places = np.where((x >= 0)[:, None], places, n - 1 - places)
            for _ in range(max(1, len(lists) // 2)):
                i = int(np.argmax(np.where(place < n, front - back, -1.0)))
                at, to = place[i], min(n, place[i] + block)
                if at >= n:
                    break
                rows = np.flatnonzero((places[i] >= at) & (places[i] < to))
                seen = values[i][places[i, rows]]
                total[rows] += x[i] * seen
                read_q[rows] += x[i] ** 2
                read_v[rows] += seen * seen
                place[i], read = to, read + int(to - at)
                front[i] = x[i] * values[i][to] if to < n else back[i]
            low, high = self.bounds(total, length, read_q, self.squares[may], read_v)
            left = high >= np.partition(low, len(may) - min(k, len(may)))[len(may) - min(k, len(may))]
            may, total, read_q, read_v = may[left], total[left], read_q[left], read_v[left]
        return may, read

    def best(self, rows: np.ndarray, query: np.ndarray, k: int) -> list[tuple]:
        """[(candidate, score)] of the k best of these rows."""
        best = sorted(zip(self.resolved(rows, query), self.ids[rows].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]
        return [(i, s) for s, i in best]

    def resolved(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Exact scores; those beyond the range of a long are its ends."""
        chosen = self.whole[rows]
        if np.abs(chosen).max(initial=0) * np.abs(query).max(initial=0) * max(self.d, 1) < 2**52:
            return (chosen @ query).astype(np.int64).tolist()
        whole = [int(x) for x in query]
        return [min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), LEAST), MOST) for row in chosen]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, shard_rows: int = 16_384, block_queries: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score, n_read): for each row that is_query holds for, the k other rows with the largest inner products.

    All rows are dealt to shards of about shard_rows by a hash of vec_id, the queries to blocks of about block_queries; a task
    searches one shard's sorted lists for one block, and the shards' best are merged by query. Scores are integers and exact; n_read counts
    the list entries that were read for the query in all shards (all would be rows times dimensions).

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id; only vectors of the same length
    are compared; ties go to the smaller vec_id; a repeated row counts once; rows of one vec_id and different vectors are candidates each,
    and as queries share one ranking, never with each other; a score beyond the range of a long counts as the end of the range; an empty table
    gives no rows; columns other than vec_id and embedding (and those of the condition) don't matter.
    """
    whole = stored(quantised(vectors, scale))
    asked = whole.where(is_query).select(F.col("vec_id").alias("query_id"), (F.col("dims") + 0).alias("dims"), F.col("vector").alias("query"))
    shards, blocks = max(1, -(-whole.count() // shard_rows)), max(1, -(-asked.count() // block_queries))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # each shard meets each block of the stated query set
    left = whole.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["dims", "shard", "block"]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(candidates) and len(queries):
            matrix = lambda x: np.frombuffer(b"".join(x), "<f8").reshape(len(x), int(candidates["dims"].iloc[0]))
            lists = SortedLists(candidates["vec_id"].to_numpy(), matrix(candidates["vector"]))
            asked = queries["query_id"].to_numpy()
            for query_id, (found, read) in zip(asked.tolist(), lists.searches(asked, matrix(queries["query"]), k), strict=True):
                rows += [(query_id, i, s, read if j == 0 else 0) for j, (i, s) in enumerate(found)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "n_read"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score long, n_read long")
    by_query = Window.partitionBy("query_id")
    found = found.withColumn("n_read", F.sum("n_read").over(by_query))
    rank = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_read")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("n_read")


OP6_SQL = """
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (
  SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
