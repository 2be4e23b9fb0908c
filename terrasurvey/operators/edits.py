"""Edits and small rules of the editor and the planner: corridors, layers, joins with fallbacks, erasing, snapping, styles."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernel

#: The layer of each segment class.
LAYER_OF = {"canopy": "canopy", "vineyard": "canopy", "waste": "waste", "row": "rows", "interrow_area": "interrows"}


def decoded(rows: DataFrame) -> DataFrame:
    """Stored rows with their points ([[x, y], ...] as JSON) as structs and their attributes (a JSON object) as a map; null or broken JSON gives empty ones."""
    points = F.transform(F.coalesce(F.from_json("points", "array<array<double>>"), F.array().cast("array<array<double>>")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    attributes = F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.withColumn("points", points).withColumn("attributes", attributes)


def layer_of(kind: Column, strict: bool) -> Column:
    """The layer of a segment's class; an unknown class is null, or an error if strict."""
    names = F.create_map(*[F.lit(x) for kv in LAYER_OF.items() for x in kv])
    found = F.try_element_at(names, kind)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown class "), kind)).cast("string")) if strict else found


def filled(attributes: Column) -> Column:
    """Attributes with '' for null."""
    return F.transform_values(attributes, lambda k, v: F.coalesce(v, F.lit("")))


def corridor(x: Column, y: Column, w: Column, h: Column, reach: float = 10.0) -> Column:
    """struct<x0, y0, x1, y1> of an axis-parallel strip prolonged at both ends of its longer axis."""
    tall = h >= w
    dx, dy = F.when(tall, F.lit(0.0)).otherwise(F.lit(reach)), F.when(tall, F.lit(reach)).otherwise(F.lit(0.0))
    return F.struct((x - dx).alias("x0"), (y - dy).alias("y0"), (x + w + dx).alias("x1"), (y + h + dy).alias("y1"))


def block_measures(canopy: DataFrame, rows: DataFrame, lanes: DataFrame, key: str) -> DataFrame:
    """Canopy, rows and inter-rows by block; blocks are those of canopy or rows, and blocks with inter-rows only are left out."""
    return canopy.join(rows, key, "full").join(lanes, key, "left")


def targets_with_canopy(gaps: DataFrame, canopy: DataFrame, key: str, value: str) -> DataFrame:
    """Gaps with their block's canopy, or that of all blocks where the block has none."""
    whole = canopy.agg(F.sum(value).alias("_all"))
    return gaps.join(canopy, key, "left").join(F.broadcast(whole)).withColumn(value, F.coalesce(value, "_all")).drop("_all")


def headlands(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_axes) of blocks with at least two rows; an error for a block with fewer."""
    n = F.count("*")
    return rows.groupBy(key).agg(F.when(n >= 2, n).otherwise(F.raise_error(F.lit("a block needs two rows")).cast("long")).alias("n_axes"))


def orphans(parts: DataFrame, seeded: DataFrame, key: str) -> DataFrame:
    """Parts without a seed."""
    return parts.select(key).exceptAll(seeded.select(key)).distinct()


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of a closed ring that are not neighbours meet."""
    n = F.size(ring) - 1
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    between = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def meet(e, f):
        a, b, c, d = e["a"], e["b"], f["a"], f["b"]
        one, two, three, four = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
        touch = ((one == 0) & between(a, b, c)) | ((two == 0) & between(a, b, d)) | ((three == 0) & between(c, d, a)) | ((four == 0) & between(c, d, b))
        return ((F.signum(one) * F.signum(two) < 0) & (F.signum(three) * F.signum(four) < 0)) | touch

    edges = F.transform(g.pairs(ring), lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    apart = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
    return F.exists(edges, lambda e: F.exists(edges, lambda f: apart(e, f) & meet(e, f)))


def valid_ring(ring: Column) -> Column:
    """Whether a ring is closed, has four positions or more, is finite, encloses an area and does not cross or touch itself."""
    finite = F.forall(ring, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    whole = (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & finite & (g.area(ring) > 0)
    return F.coalesce(F.when(whole, ~crosses_itself(ring)).otherwise(False), F.lit(False))


def largest_valid(parts: Column) -> Column:
    """The ring with the largest area of an array's valid ones; null without any."""
    ranked = F.transform(F.filter(parts, valid_ring), lambda r: F.struct(g.area(r).alias("area"), r.alias("ring")))
    return F.aggregate(ranked, F.lit(None).cast(f"struct<area:double,ring:array<{g.POINT}>>"), lambda s, r: F.when(s.isNull() | (r["area"] > s["area"]), r).otherwise(s))["ring"]


def snapped(ring: Column, step: float = 0.01) -> Column:
    """Vertices on a grid of `step`, without repeats in a row."""
    places = F.transform(ring, lambda p: F.struct(F.round(p["x"] / step).alias("x"), F.round(p["y"] / step).alias("y")))
    kept = F.filter(places, lambda p, i: (i == 0) | (p != F.get(places, i - 1)))
    return F.transform(kept, lambda p: F.struct((p["x"] * step).alias("x"), (p["y"] * step).alias("y")))


def joined_strips(boxes: DataFrame, keys: list[str], x1: float, y1: float) -> DataFrame:
    """(keys, ring, x0, y0, x1, y1, cover): one strip from several of a key: the convex hull of them all, cut at the tile's edges, with its bounds and the first one's attributes."""
    fields = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in keys)
    x, y, w, h = (F.col(c) for c in "xywh")
    corners = boxes.select(*keys, "interrow_id", "cover", F.explode(F.slice(g.box_ring(x, y, w, h), 1, 4)).alias("p")).select(*keys, "interrow_id", "cover", "p.x", "p.y")

    def around(rows):
        ring = [{"x": float(a), "y": float(b)} for a, b in kernel.hull(rows[["x", "y"]].to_numpy())]
        first = rows.sort_values("interrow_id").iloc[0]
        return pd.DataFrame({**{k: [first[k]] for k in keys}, "ring": [ring], "cover": [first["cover"]]})

    hulls = corners.groupBy(*keys).applyInPandas(around, f"{fields}, ring array<{g.POINT}>, cover string")
    for axis, limit, below in (("x", 0.0, False), ("y", 0.0, False), ("x", x1, True), ("y", y1, True)):
        hulls = hulls.withColumn("ring", g.clip_box(F.col("ring"), axis, F.lit(limit), below))
    return hulls.select(*keys, "ring", g.bounds(F.col("ring")).alias("b"), "cover").select(*keys, "ring", "b.*", "cover")


def erased(lines: DataFrame, key: str, first: str, last: str, at: float, radius: float) -> DataFrame:
    """(key, run, first, last): what a round brush leaves of straight lines along one axis: sampled every max(0.5, radius / 3), runs of two samples or more that reach over 2."""
    step = max(0.5, radius / 3)
    n = F.greatest(F.ceil((F.col(last) - F.col(first)) / step), F.lit(1))
    s = lines.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col(first) + (F.col(last) - F.col(first)) * i / n)).alias("i", "x"))
    s = s.where(F.abs(F.col("x") - at) > radius)
    run = F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i"))
    out = s.withColumn("run", run).groupBy(key, "run").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
    return out.where((F.col("n") >= 2) & (F.col("last") - F.col("first") >= 2)).select(key, "first", "last")


def interpolated(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between stops, constant beyond the first and last."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(value < x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(value <= stops[0][0], float(stops[0][1])).otherwise(out)


class GapTable:
    """A table function: the gaps of at least `least` between sorted intervals a, b (arrays)."""

    def eval(self, a: list, b: list, least: float):
        end = None
        for x, y in sorted(zip(a, b, strict=True)):
            if end is not None and x - end >= least:
                yield end, x
            end = y if end is None else max(end, y)


def register(spark: SparkSession) -> None:
    """Makes the library's table function known to SQL: survey_gaps(a, b, least)."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("survey_gaps", udtf(GapTable, returnType="gap_start double, gap_end double"))
