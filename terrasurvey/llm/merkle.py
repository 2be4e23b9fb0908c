"""A Merkle manifest of a dataset: a tree of digests for each source, one above them, and a proof for every row."""

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: The columns a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that a run of consecutive nodes has, the levels that a task reduces at once (at least), and the nodes that the driver takes at most.
FAN, LEVELS, MOST = 3, 8, 65_536


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value `-` if it is null, else the number of its UTF-8 bytes, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in texts]), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], fan: int, most: int | None) -> list[list[str]]:
    """A block's levels from its nodes up: `most` of them above the first, or (None) until one node remains."""
    out = [nodes]
    while (len(out) <= most) if most is not None else (len(out[-1]) > 1):
        last = out[-1]
        out.append([digest(last[i : i + fan]) for i in range(0, len(last), fan)])
    return out


def path(tree: list[list[str]], place: int, fan: int) -> tuple[list[str], list[str]]:
    """For each level below the last the siblings before and after the node above `place`, as text."""
    left, right = [], []
    for level in tree[:-1]:
        first = place - place % fan
        left.append("".join(level[first:place]))
        right.append("".join(level[place + 1 : first + fan]))
        place //= fan
    return left, right


def runs_of(batches, keys: int):
    """(key, rows) of each run of rows that are equal in the first columns, of a partition sorted by them; a run may go on in the next batches."""
    key, parts = None, []
    for batch in batches:
        at = 0
        for k, run in groupby(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True)):
            n = sum(1 for _ in run)
            if parts and k != key:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = k
            parts.append(batch.slice(at, n))
            at += n
    if parts:
        yield key, pa.Table.from_batches(parts)


def placed(rows: DataFrame, group: list[str], *order: str | Column) -> DataFrame:
    """rows with `pos`, their place in their group from 0, and `size`, the group's rows. order: begins with the group.

    Rows are sorted in ranges, so that a group may take many tasks, and the groups' sizes are added up from range to range.
    """
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy(*group)  # a row for each range of a group
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return ranged.join(sizes, [*group, "_range"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def block_roots(nodes: DataFrame, group: list[str], fan: int, depth: int) -> DataFrame:
    """(group, block, alone, node): of each fan**depth consecutive nodes of a group the node above them; alone: the block is the whole group."""
    rows = nodes.select(*group, F.floor(F.col("pos") / fan**depth).alias("block"), (F.col("size") <= fan**depth).alias("alone"), "pos", "node")
    keys = [*group, "block", "alone"]
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys]

    def run(batches):
        for key, block in runs_of(batches, len(keys)):
            top = levels(block.column("node").to_pylist(), fan, None if key[-1] else depth)[-1][0]
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True), node=top)], schema=pa.schema([*[block.schema.field(c) for c in keys], ("node", pa.string())]))

    return rows.repartition(*group, "block").sortWithinPartitions(*keys, "pos").mapInArrow(run, ", ".join([*fields, "node string"]))


def with_paths(nodes: DataFrame, group: list[str], above: dict, fan: int, depth: int) -> DataFrame:
    """nodes with `subroot`, `left` and `right`: the siblings, as text, on the way from each node to the top of all. above: of each (group, block) its links and subroot."""
    kept = [c for c in nodes.columns if c not in ("size", "pos")]
    rows = nodes.select(*group, F.floor(F.col("pos") / fan**depth).alias("block"), (F.col("size") <= fan**depth).alias("alone"), "pos", *[F.col(c).alias(f"kept_{c}") for c in kept])
    n, spread = len(group), nodes.sparkSession.sparkContext.broadcast(above)
    fields = ", ".join([*[f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in kept], "subroot string, left array<string>, right array<string>"])

    def run(batches):
        for key, block in runs_of(batches, n + 2):
            tree = levels(block.column("kept_node").to_pylist(), fan, None if key[-1] else depth)
            link, subroot = spread.value[key[: n + 1]]
            left, right = followed(link)
            ways = [path(tree, i, fan) for i in range(len(tree[0]))]
            sides = [pa.array([way[side] + rest for way in ways], pa.list_(pa.string())) for side, rest in ((0, left), (1, right))]
            own = pa.array([subroot] * len(ways), pa.string())
            whole = pa.table([*[block.column(f"kept_{c}") for c in kept], own, *sides], names=[*kept, "subroot", "left", "right"])
            yield from whole.to_batches(max_chunksize=4096)

    return rows.repartition(*group, "block").sortWithinPartitions(*group, "block", "alone", "pos").mapInArrow(run, fields)


def followed(link: tuple | None) -> tuple[list[str], list[str]]:
    """The siblings along linked steps (before, after, next step); blocks share the upper steps."""
    left, right = [], []
    while link:
        left.append(link[0])
        right.append(link[1])
        link = link[2]
    return left, right


def linked(nodes: list[str], fan: int, above: tuple | None = None) -> tuple[str, list]:
    """The top node over nodes, and for each of them the linked steps to it and on to what is above."""
    tree = levels(nodes, fan, None)
    links = [above]
    for level in tree[-2::-1]:
        links = [("".join(level[i - i % fan : i]), "".join(level[i + 1 : i - i % fan + fan]), links[i // fan]) for i in range(len(level))]
    return tree[-1][0], links


def manifest(leaves: DataFrame, fan: int = FAN, depth: int = LEVELS, most: int = MOST) -> DataFrame:
    """leaves with subroot, root, left and right: left and right hold, level by level, the digests before and after the row's own in its run.

    leaves: doc_id, source, node (the leaf's digest) and any columns but those named here; see op13_merkle for the tree. The rows of a source are ranked by
    ranges; blocks of fan**depth leaves are reduced each in a task, a source of a third of all rows in as many tasks as it has blocks; what
    remains, a node for each block, is the small top of the tree. The driver builds it (`most` nodes at most: depth grows with the rows until
    blocks are few enough) and broadcasts the rest of the way up, in which blocks share the upper steps; tasks then finish every row's way.
    Where single-block sources alone are more than `most`, their nodes are reduced by blocks and finished in tasks likewise.

    Rows of one source are ordered by doc_id (null first), then by digest; equal rows are leaves each; null sources are one source, before all; an
    empty table gives no rows.
    """
    rows = leaves.withColumn("_named", F.col("source").isNotNull()).withColumn("_name", F.coalesce(F.col("source").cast("string"), F.lit("")))
    group = ["_named", "_name"]
    nodes = stored(placed(rows, group, *group, F.asc_nulls_first("doc_id"), "node"))
    total = nodes.count()
    while fan**depth * most < 2 * total:
        depth += 1
    roots = stored(block_roots(nodes, group, fan, depth))
    if roots.count() <= most:
        top, above = driver_tree(roots.collect(), fan)
        out = with_paths(nodes, group, above, fan, depth)
    else:
        out, top = over_many(nodes, roots, group, fan, depth)
    return out.withColumn("root", F.lit(top).cast("string")).select(*leaves.columns, "subroot", "root", "left", "right")


def by_source(roots: list, fan: int) -> dict:
    """Of each source its subroot and the links of its blocks within it, blocks in order. roots: (named, name, block, ..., node)."""
    out = {}
    for key, blocks in groupby(sorted(roots, key=lambda r: (r["_named"], r["_name"].encode(), r["block"])), key=lambda r: (r["_named"], r["_name"])):
        out[key] = [r["node"] for r in blocks]
    return out


def driver_tree(roots: list, fan: int) -> tuple[str | None, dict]:
    """(root, of each block its links and its source's subroot) of the top tree."""
    sources = by_source(roots, fan)
    if not sources:
        return None, {}
    subroots = [linked(nodes, fan)[0] for nodes in sources.values()]
    top, ups = linked(subroots, fan)
    above = {}
    for (key, nodes), subroot, up in zip(sources.items(), subroots, ups, strict=True):
        above |= {(*key, i): (link, subroot) for i, link in enumerate(linked(nodes, fan, up)[1])}
    return top, above


class Ways(dict):
    """Links of blocks; a block that is a whole source has none within it."""

    def __missing__(self, key):
        return None, None


def over_many(nodes: DataFrame, roots: DataFrame, group: list[str], fan: int, depth: int) -> tuple[DataFrame, str]:
    """(rows with subroot, left and right; the root) for more sources than the driver takes: a second tree over the subroots, reduced by blocks too."""
    sources = by_source(roots.where("not alone").collect(), fan)  # sources of more than a block have 2 * rows / fan**depth blocks at most
    tops = {key: linked(blocks, fan) for key, blocks in sources.items()}
    large = nodes.sparkSession.createDataFrame([(*key, top) for key, (top, _) in tops.items()], "_named boolean, _name string, node string")
    subroots = roots.where("alone").select(*group, "node").unionByName(large)
    upper = stored(placed(subroots.withColumn("_all", F.lit(True)), ["_all"], "_all", *group))
    uppers = block_roots(upper, ["_all"], fan, depth).collect()
    top, links = linked([r["node"] for r in sorted(uppers, key=lambda r: r["block"])], fan)
    ways = with_paths(upper, ["_all"], {(True, i): (link, None) for i, link in enumerate(links)}, fan, depth)
    ways = stored(ways.select(*group, F.col("node").alias("subroot"), F.col("left").alias("_left"), F.col("right").alias("_right")))
    above = Ways({(*key, i): (link, None) for key, (_, own) in tops.items() for i, link in enumerate(own)})
    out = with_paths(nodes, group, above, fan, depth).drop("subroot").join(ways, group)
    return out.withColumn("left", F.concat("left", "_left")).withColumn("right", F.concat("right", "_right")).drop("_left", "_right"), top


def proof_digest(left: str, right: str) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def folded(node: Column, left: str, right: str) -> Column:
    """The root that a leaf's digest and the siblings of a proof give."""
    return F.aggregate(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b")), node, lambda at, side: F.sha2(F.concat(side["a"], at, side["b"]), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether the tampered table still folds to the root.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Null values and empty texts are told apart by a leaf; very long texts are digested whole,
    where they are read; a null doc_id is not tampered with; equal rows, ties, null sources and empty tables: see manifest; columns other than
    those five don't matter.
    """
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in COLUMNS]
    number = F.col("doc_id").cast("string")
    cut = number.isNotNull() & (F.crc32(number) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    other = F.when(cut, leaf([*values[:-1], F.translate("text", "\n", "")]))
    rows = manifest(docs.select("doc_id", "source", leaf(values).alias("node"), other.alias("other")))
    out = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest("left", "right").alias("proof_sha256"), folded(F.coalesce("other", "node"), "left", "right").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
WITH RECURSIVE numbered AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS number,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents
), coded AS (
  SELECT doc_id, source, coalesce(crc % 2 = 0, false) AS hit, text,
    coalesce(strlen(number) || ':' || number, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM numbered
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other FROM coded
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes(level, source, pos, n, h) AS (
  SELECT 0, source, pos, n, h FROM ranked
  UNION ALL
  SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, source, pos // 3, n
), subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 3, n
), steps AS (
  SELECT r.source, r.pos, n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < r.pos // CAST(3 ** n.level AS BIGINT)), '') AS l,
    coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > r.pos // CAST(3 ** n.level AS BIGINT)), '') AS r
  FROM ranked r JOIN nodes n ON n.source IS NOT DISTINCT FROM r.source AND n.n > 1 AND n.pos // 3 = r.pos // CAST(3 ** (n.level + 1) AS BIGINT) GROUP BY 1, 2, 3
  UNION ALL
  SELECT r.source, r.pos, 100 + n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < s.pos // CAST(3 ** n.level AS BIGINT)), ''),
    coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > s.pos // CAST(3 ** n.level AS BIGINT)), '')
  FROM ranked r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source JOIN upper_nodes n ON n.n > 1 AND n.pos // 3 = s.pos // CAST(3 ** (n.level + 1) AS BIGINT) GROUP BY 1, 2, 3
), way AS (
  SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY level) AS step FROM steps
), proofs AS (
  SELECT source, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM way GROUP BY 1, 2
), folds(source, pos, step, h) AS (
  SELECT source, pos, 0, coalesce(other, h) FROM ranked
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(w.l || f.h || w.r) FROM folds f JOIN way w ON w.source IS NOT DISTINCT FROM f.source AND w.pos = f.pos AND w.step = f.step + 1
), ends AS (
  SELECT source, pos, arg_max(h, step) AS folded FROM folds GROUP BY 1, 2
)
SELECT r.doc_id, r.h AS leaf, s.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = t.h AS verified
FROM ranked r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source JOIN ends e ON e.source IS NOT DISTINCT FROM r.source AND e.pos = r.pos
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM r.source AND p.pos = r.pos CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) t
"""
