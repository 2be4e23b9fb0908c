"""Masks: polygons to runs of pixels, pixels to outlines, flood fill, straight rows, and downsampled reads."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import spread, stored
from .graph import components
from .raster import complete


#: Lines whose crossings are put in order together.
TOGETHER = 64


def rasterised(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, py, start, end): the runs of pixels (from start, before end) whose centres lie in a shape.

    shapes: keys and rings, an array of closed rings of struct<x, y>; holes are rings like others, by the even-odd rule. Each edge meets the lines
    of pixel centres that it crosses, and on each line the crossings are paired in order. Nothing is as large as the shape's area.
    """
    edges = shapes.select(*keys, F.explode("rings").alias("ring")).select(*keys, F.explode(g.pairs(F.col("ring"))).alias("e"))
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    # half-open: a corner on a line of centres counts for one of its edges
    lines = F.sequence(F.ceil(low - 0.5).cast("long"), (F.ceil(high - 0.5) - 1).cast("long"))
    lines = edges.where(F.ceil(low - 0.5) < F.ceil(high - 0.5)).select(*keys, "e", F.explode(lines).alias("py"))
    at = F.col("e.a.x") + (F.col("py") + 0.5 - F.col("e.a.y")) * (F.col("e.b.x") - F.col("e.a.x")) / (F.col("e.b.y") - F.col("e.a.y"))
    # a closed ring crosses each line an even number of times, so lines can be numbered on together: one group for each line would cost more than its few rows
    order = Window.partitionBy(*keys, F.floor(F.col("py") / TOGETHER)).orderBy("py", "at")
    crossings = lines.select(*keys, "py", at.alias("at")).withColumn("k", F.row_number().over(order)).withColumn("to", F.lead("at").over(order))
    pixel = lambda c: F.ceil(F.col(c) - 0.5).cast("long")
    return crossings.where("k % 2 = 1").select(*keys, "py", pixel("at").alias("start"), pixel("to").alias("end")).where(F.col("start") < F.col("end"))


def border(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the directed edges of pixels (keys, px, py) that no other pixel of the key shares, with the pixels on their left."""
    x, y = F.col("px"), F.col("py")
    side = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    sides = F.array(side(x, y, x + 1, y), side(x + 1, y, x + 1, y + 1), side(x + 1, y + 1, x, y + 1), side(x, y + 1, x, y))
    e = pixels.select(*keys, "px", "py").distinct().select(*keys, F.explode(sides).alias("e"))
    where = [F.least("e.x0", "e.x1").alias("_x"), F.least("e.y0", "e.y1").alias("_y"), (F.col("e.x0") == F.col("e.x1")).alias("_up")]
    lone = e.groupBy(*keys, *where).agg(F.count("*").alias("_n"), F.first("e").alias("e")).where("_n = 1")
    return lone.select(*keys, "e.*")


def outlines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, area): the outlines of each key's pixels, counter-clockwise, and of their holes, clockwise and with negative area.

    Pixels that only touch at a corner are apart. Straight runs are one edge. The border edges of one region are one group.
    """
    fields = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def trace(edges: list) -> list[tuple]:
        leaving: dict = {}
        for x0, y0, x1, y1 in edges:
            leaving.setdefault((x0, y0), []).append((x1, y1))
        out = []
        for start in sorted(leaving):
            while leaving[start]:
                at, ring = leaving[start].pop(), [start]
                while at != start:
                    before, ways = ring[-1], leaving[at]
                    ring.append(at)
                    # where two pixels touch at a corner, turn left, so that each keeps its own outline
                    left = (at[0] - (at[1] - before[1]), at[1] + (at[0] - before[0]))
                    way = left if left in ways else ways[0]
                    ways.remove(way)
                    at = way
                n = len(ring)
                turn = [ring[i] for i in range(n) if (ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0])]
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(turn, [*turn[1:], turn[0]], strict=True)) / 2
                out.append(([{"x": float(x), "y": float(y)} for x, y in turn], area))
        return out

    def run(batches):
        for rows in complete(batches, keys):
            fresh = np.zeros(len(rows), bool)
            fresh[0] = True
            for k in keys:
                codes = pd.factorize(rows[k], use_na_sentinel=False)[0]
                fresh[1:] |= codes[1:] != codes[:-1]
            starts, edges = np.flatnonzero(fresh), rows[["x0", "y0", "x1", "y1"]].to_numpy().tolist()
            found = [trace(edges[i:j]) for i, j in zip(starts, [*starts[1:], len(rows)], strict=True)]
            names = rows[keys].iloc[np.repeat(starts, [len(f) for f in found])].reset_index(drop=True)
            yield names.assign(ring=[r for f in found for r, _ in f], area=[a for f in found for _, a in f])

    # a batch has many small groups, which are traced one after the other
    return spread(border(pixels, keys), *keys).sortWithinPartitions(*keys).mapInPandas(run, f"{fields}, ring array<struct<x:double,y:double>>, area double")


def in_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """pixels (keys, px, py), each once, with `start`: the first pixel of the run of neighbours on its line."""
    line = Window.partitionBy(*keys, "py")
    p = pixels.select(*keys, "px", "py").distinct().withColumn("_gap", F.col("px") - F.row_number().over(line.orderBy("px")))
    return p.withColumn("start", F.min("px").over(Window.partitionBy(*keys, "py", "_gap"))).drop("_gap")


def regions(pixels: DataFrame, keys: list[str], cell: int = 64) -> DataFrame:
    """(keys, px, py, region): pixels with the region they belong to over their eight neighbours; a region is named by a number without a meaning.

    The nodes are runs of pixels, numbered, so a region of any size has few of them. Runs on lines next to each other meet in cells along the line and are
    linked if they touch, in the one cell where their common part begins.
    """
    p = stored(in_runs(pixels, keys))
    lines = stored(p.groupBy(*keys, "py", "start").agg((F.max("px") + 1).alias("end")).withColumn("run", F.monotonically_increasing_id()))
    along = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    upper = lines.select(*keys, "py", "run", "start", "end").withColumn("_at", along(F.col("start") - 1, F.col("end")))
    lower = lines.select(*keys, (F.col("py") - 1).alias("py"), F.col("run").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    lower = lower.withColumn("_at", along(F.col("b_start"), F.col("b_end") - 1))
    begin = F.greatest(F.col("start") - 1, F.col("b_start"))
    touch = (begin < F.least(F.col("end") + 1, F.col("b_end"))) & (F.floor(begin / cell) == F.col("_at"))
    links = upper.join(lower, [*keys, "py", "_at"]).where(touch).select(F.col("run").alias("a"), "b")
    roots = lines.select(*keys, "py", "start", "run").join(components(links), F.col("run") == F.col("node"), "left")
    return p.join(roots.select(*keys, "py", "start", F.coalesce("root", "run").alias("region")), [*keys, "py", "start"]).drop("start")


def flooded(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(tile, px, py): the pixels that seeds reach over the eight neighbours of each pixel. Every region counts whole: no padding or rounds end the fill."""
    found = stored(regions(pixels, ["tile"]))
    hit = found.join(seeds.select("tile", "px", "py"), ["tile", "px", "py"], "left_semi").select("region").distinct()
    return found.join(hit, "region", "left_semi").select("tile", "px", "py")


def row_lines(pixels: DataFrame, block: str, piece: str, slim: float = 0.35, swing: float = 8.0) -> DataFrame:
    """(block, piece, x0, y0, x1, y1): a straight line along each slim piece of pixels (block, piece, px, py) that follows its block's direction.

    A piece is slim if its spread across is at most `slim` of that along its main axis; the block's direction is the mean of its pieces' axes at
    doubled angles, weighted by their pixels, and pieces that turn from it by more than `swing` degrees are left out.
    """
    keys = [block, piece]
    s = pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.var_pop("px").alias("xx"), F.var_pop("py").alias("yy"), F.covar_pop("px", "py").alias("xy"))
    root = F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2.0)) + F.col("xy") * F.col("xy"))
    mean = (F.col("xx") + F.col("yy")) / 2
    s = s.withColumn("l1", mean + root).withColumn("l2", F.greatest(mean - root, F.lit(0.0))).withColumn("axis", 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    s = s.where((F.col("n") > 1) & (F.sqrt("l2") <= slim * F.sqrt("l1")))
    whole = Window.partitionBy(block)
    main = 0.5 * F.atan2(F.sum(F.col("n") * F.sin(2 * F.col("axis"))).over(whole), F.sum(F.col("n") * F.cos(2 * F.col("axis"))).over(whole))
    off = F.abs(F.degrees(F.col("axis") - main)) % 180
    kept = s.withColumn("off", F.least(off, 180 - off)).where(F.col("off") <= swing).select(*keys, "cx", "cy", "axis")
    along = (F.col("px") - F.col("cx")) * F.cos("axis") + (F.col("py") - F.col("cy")) * F.sin("axis")
    ends = pixels.join(kept, keys).groupBy(*keys, "cx", "cy", "axis").agg(F.min(along).alias("a"), F.max(along).alias("b"))
    place = lambda c, f, t: (F.col(c) + F.col(t) * f("axis"))
    return ends.select(*keys, place("cx", F.cos, "a").alias("x0"), place("cy", F.sin, "a").alias("y0"), place("cx", F.cos, "b").alias("x1"), place("cy", F.sin, "b").alias("y1"))


def downsampled(pixels: DataFrame, keys: list[str], factor: int, value: str) -> DataFrame:
    """(keys, px, py, value): means of blocks of factor x factor pixels; pixels without a value don't count."""
    block = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return pixels.groupBy(*keys, block("px"), block("py")).agg(F.avg(value).alias(value))


def segmented(tiles: DataFrame, model, precomputed: DataFrame | None = None, allow_precomputed: bool = False) -> DataFrame:
    """(name, class, ring, source): what a model finds on tiles (name, content), or labels made before where that is explicitly allowed.

    model: a function of an iterator of data frames (name, content) that yields data frames (name, class, ring), or None where no model is at hand. Then
    precomputed labels (see precomputed_features) are taken if they are allowed; else it is an error, never an empty result.
    """
    if model is not None:
        return tiles.mapInPandas(model, "name string, class string, ring array<array<double>>").withColumn("source", F.lit("model"))
    if precomputed is None or not allow_precomputed:
        raise ValueError("no model is at hand and precomputed labels are not allowed")
    return precomputed_features(tiles.select("name"), precomputed).withColumn("source", F.lit("precomputed"))


#: Which precomputed labels are kept, and their classes; and the names of tiles that have them.
CLASSES = {"vineyard": "canopy", "waste": "waste"}
TILE = r"^siret3_r\d{3}_c\d{3}$"


def precomputed_features(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, class, ring) of tiles' precomputed labels (name, label, kind, ring): polygons of known labels only.

    A tile whose name is not of the kind that has labels is an error, and so is finding none for all tiles.
    """
    named = tiles.select(F.when(F.col("name").rlike(TILE), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no precomputed labels for "), "name"))).alias("name"))
    classes = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    have = labels.join(named, "name", "left_semi")
    if have.isEmpty():
        raise ValueError("no precomputed labels for these tiles")
    found = have.where(F.col("kind").isin("Polygon", "MultiPolygon")).withColumn("class", F.try_element_at(classes, F.col("label")))
    return found.where("class is not null").select("name", "class", "ring")
