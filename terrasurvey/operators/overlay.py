"""Overlay of layers of polygons of any size: edges cut at grid cells, each cell swept by itself; repair and dissolve of rings."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernel

#: Edges that a task sweeps at once where a layer is cut into columns.
COLUMN_EDGES = 4_000
RING = "array<struct<x:double,y:double>>"
#: Points of a ring that is looked at together with others, and pairs of its corners and edges that a task holds at once.
SHORT, PAIRS = 24, 1 << 19
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
PARTS = pa.list_(pa.struct([("outer", POINTS), ("holes", pa.list_(POINTS)), ("area", pa.float64())]))


def edges(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, layer, shape, turn, x1, y1, x2, y2): the edges of rings (open or closed) that are not vertical, left to right; turn is -1 where that is backwards."""
    closed = F.concat("ring", F.slice("ring", 1, 1))
    e = shapes.select(*keys, "layer", "shape", F.explode(g.pairs(closed)).alias("e")).where("e.a.x <> e.b.x")
    forward = F.col("e.a.x") < F.col("e.b.x")
    end = lambda one, other, c: F.when(forward, F.col(f"e.{one}.{c}")).otherwise(F.col(f"e.{other}.{c}"))
    return e.select(*keys, "layer", "shape", F.when(forward, 1).otherwise(-1).alias("turn"), end("a", "b", "x").alias("x1"), end("a", "b", "y").alias("y1"), end("b", "a", "x").alias("x2"), end("b", "a", "y").alias("y2"))


def in_columns(e: DataFrame, width) -> DataFrame:
    """Edges cut at the sides of columns of a width; `cx` numbers the columns. A null width is one column."""
    e = e.withColumn("cx", F.explode(F.when(width.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("x1") / width), F.ceil(F.col("x2") / width) - 1))))
    y = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1"))
    a, b = F.greatest(F.col("x1"), F.col("cx") * width), F.least(F.col("x2"), (F.col("cx") + 1) * width)  # these pass over a null
    kept = [c for c in e.columns if c not in ("x1", "y1", "x2", "y2")]
    # an edge's own ends are kept as they are
    e = e.select(*kept, a.alias("_a"), F.when(a == F.col("x1"), F.col("y1")).otherwise(y(a)).alias("_ya"), b.alias("_b"), F.when(b == F.col("x2"), F.col("y2")).otherwise(y(b)).alias("_yb"))
    return e.where("_a < _b").select(*kept, *[F.col(c).alias(n) for c, n in (("_a", "x1"), ("_ya", "y1"), ("_b", "x2"), ("_yb", "y2"))])


def in_cells(e: DataFrame, keys: list[str], size) -> DataFrame:
    """Edges cut at columns and then at the rows of cells that their shape reaches within the column; `cx` and `cy` number the cells.

    What of a shape lies below or above a cell is moved onto the cell's lower or upper side, so that a line from below still meets as many of
    its edges before each point of the cell.
    """
    e = in_columns(e, size)
    column = Window.partitionBy(*keys, "shape", "cx")
    e = e.withColumn("_low", F.floor(F.min(F.least("y1", "y2")).over(column) / size)).withColumn("_high", F.ceil(F.max(F.greatest("y1", "y2")).over(column) / size) - 1)
    e = e.withColumn("cy", F.explode(F.sequence(F.col("_low"), F.greatest("_low", "_high")))).drop("_low", "_high")
    bottom, top, rise = F.col("cy") * size, (F.col("cy") + 1) * size, F.col("y2") - F.col("y1")
    held = lambda v, a, b: F.greatest(a, F.least(b, v))
    at = lambda y: F.when(rise == 0, F.col("x2")).otherwise(held(F.col("x1") + (y - F.col("y1")) / rise * (F.col("x2") - F.col("x1")), F.col("x1"), F.col("x2")))
    one, two = F.least(at(bottom), at(top)), F.greatest(at(bottom), at(top))
    level = lambda x: held(F.col("y1") + rise * (x - F.col("x1")) / (F.col("x2") - F.col("x1")), bottom, top)
    part = lambda a, b: F.struct(a.alias("x1"), level(a).alias("y1"), b.alias("x2"), level(b).alias("y2"))
    kept = [c for c in e.columns if c not in ("x1", "y1", "x2", "y2")]
    parts = F.array(part(F.col("x1"), one), part(one, two), part(two, F.col("x2")))
    return e.select(*kept, F.explode(F.filter(parts, lambda p: p["x1"] < p["x2"])).alias("p")).select(*kept, "p.*")


def swept_edges(rows: pd.DataFrame) -> np.ndarray:
    """The rows of one task as the sweep takes them."""
    shape, _ = pd.factorize(rows["shape"])
    return np.column_stack([rows[["x1", "y1", "x2", "y2", "turn"]].to_numpy(float), shape, rows["layer"].to_numpy(float)])


def cell_size(shapes: DataFrame, times: float = 4.0) -> float:
    """Cells a few times as large as shapes are on average: few shapes share a cell, and few cells share a shape."""
    b = shapes.select(g.bounds(F.col("ring")).alias("b")).select("b.*")
    return times * max(1e-6, b.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0)


def overlay_areas(shapes: DataFrame, keys: list[str], wanted: dict, n_layers: int, size: float | None = None) -> DataFrame:
    """(keys, one area for each of `wanted`): the area where its rule holds for the layers that cover a place.

    shapes: keys, layer (from 0), shape (unique within the keys), ring (array of struct<x, y>), filled by parity. wanted: name -> rule of a list with a flag for each layer.
    A cell's edges are one group, so shapes of one key may be any number; keys without edges have no row.
    """
    names = list(wanted)
    pieces = in_cells(edges(shapes, keys), keys, F.lit(size or cell_size(shapes)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        e = swept_edges(rows)
        found = {c: [sum(map(kernel.area_of, kernel.swept(e, n_layers, wanted[c])))] for c in names}
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, **found})

    fields = ", ".join([*[f"{k} {shapes.schema[k].dataType.simpleString()}" for k in keys], *[f"{c} double" for c in names]])
    cells = pieces.groupBy(*keys, "cx", "cy").applyInPandas(run, fields)
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def column_width(e: DataFrame, keys: list[str], most: int = COLUMN_EDGES) -> DataFrame:
    """(keys, width): columns so wide that each has about `most` edges; one column where there are no more."""
    n = e.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x1").alias("low"), F.max("x2").alias("high"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    return n.select(*keys, F.when(F.col("n") > most, span / F.ceil(F.col("n") / most)).alias("width"))


def passable_cells(shapes: DataFrame, keys: list[str], rule, n_layers: int, most: int = COLUMN_EDGES) -> DataFrame:
    """(keys, cell, x0, x1, a0, b0, a1, b1): the trapezoids of the ground on which a rule holds; see overlay_areas.

    A key of more than `most` edges is cut into columns, each swept by itself; a trapezoid's number has its column in the upper half.
    """
    e = edges(shapes, keys)
    cut = in_columns(e.join(column_width(e, keys, most), keys), F.col("width")).drop("width")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(x0, x1, *p[2:4], *p[4:6]) for x0, x1, pieces in kernel.swept(swept_edges(rows), n_layers, rule) for p in pieces]
        cells = pd.DataFrame(out, columns=["x0", "x1", "a0", "b0", "a1", "b1"]).astype(float)
        cells.insert(0, "cell", (int(rows["cx"].iloc[0]) << 32) + np.arange(len(cells)))
        for k in reversed(keys):
            cells.insert(0, k, rows[k].iloc[0])
        return cells

    fields = ", ".join([*[f"{k} {shapes.schema[k].dataType.simpleString()}" for k in keys], "cell long, x0 double, x1 double, a0 double, b0 double, a1 double, b1 double"])
    return cut.groupBy(*keys, "cx").applyInPandas(run, fields)


def as_points(ring: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]]


def as_array(ring) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in ring], float).reshape(-1, 2)


def polygons(outer: list[np.ndarray], areas: np.ndarray) -> pa.ListArray:
    """Rows of polygons without holes; outer: for each of a row's polygons the open rings (row, point, axis), areas: (row, polygon)."""
    rows, n = areas.shape
    closed = [np.concatenate((r, r[:, :1]), 1) for r in outer]
    p = np.concatenate(closed, 1).reshape(-1, 2)
    ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(np.tile(sizes, rows)))), pa.int32())
    points = pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["x", "y"])
    rings = pa.ListArray.from_arrays(ends([r.shape[1] for r in closed]), points)
    holes = pa.array([[]], PARTS.value_type.field("holes").type).take(pa.array(np.zeros(rows * n, int)))
    return pa.ListArray.from_arrays(ends([n]), pa.StructArray.from_arrays([rings, holes, pa.array(areas.reshape(-1))], ["outer", "holes", "area"])).cast(PARTS)


def repaired(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """shapes with `parts`: the sound polygons that a ring, which may cross or touch itself, winds around; each has an outer ring and holes, closed.

    Crossings become vertices and the faces that the ring winds around are kept, so a bow tie gives its two triangles and a loop that is passed
    twice the same way counts once. Rings of fewer than three different points, null ones and those without area have no parts.
    Rings of at most SHORT points that cross themselves once or never are taken many at once, others are swept one by one.
    """
    kind = f"array<struct<outer:{RING},holes:array<{RING}>,area:double>>"
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in shapes.schema], f"parts {kind}"])

    def one(p: np.ndarray) -> list[dict]:
        p = p[np.isfinite(p).all(axis=1)]
        if len(np.unique(p, axis=0)) < 3:
            return []
        parts = kernel.dissolved([p], winding=True)
        return [{"outer": as_points(o), "holes": [as_points(h) for h in holes], "area": kernel.turned_area(o) + sum(map(kernel.turned_area, holes))} for o, holes in parts]

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ring))
            n = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), int)
            flat, first = column.flatten(), np.cumsum(n) - n
            p = np.stack([np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in ("x", "y")], 1)
            has = np.flatnonzero(n > 0)
            shut = np.zeros(len(n), int)
            shut[has] = (p[first[has]] == p[first[has] + n[has] - 1]).all(1)
            sound = np.zeros(len(n), bool)
            sound[has] = np.logical_and.reduceat(np.isfinite(p).all(1), first[has]) if len(has) else False
            size, order, found, left = n - shut, [], [], np.ones(len(n), bool)
            for k in np.unique(size[sound & (size >= 3) & (size <= SHORT)]):
                rows = np.flatnonzero(sound & (size == k))
                some = PAIRS // (k * k)
                for part in (rows[i : i + some] for i in range(0, len(rows), some)):
                    for which, outer, areas in kernel.plain_parts(p[first[part, None] + np.arange(k)]):
                        order.append(part[which])
                        found.append(polygons(outer, areas))
                        left[order[-1]] = False
            order.append(np.flatnonzero(left))
            found.append(pa.array([one(p[first[i] : first[i] + n[i]]) for i in order[-1]], PARTS))
            parts = pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(order))))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])

    return shapes.mapInArrow(run, fields)


def largest_repaired(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """shapes with the outer ring of the largest part that repair finds in place of their ring; those without any part go."""
    best = F.array_max(F.transform("parts", lambda p: F.struct(p["area"].alias("area"), p["outer"].alias("outer"))))
    return repaired(shapes, ring).withColumn(ring, best["outer"]).where(F.col(ring).isNotNull()).drop("parts")


def dissolved(shapes: DataFrame, keys: list[str], most: int = COLUMN_EDGES) -> DataFrame:
    """(keys, part, outer, holes, area): the union of each key's rings as sound polygons.

    Rings are dissolved in tasks of about `most` edges first, columns of a key by themselves; what they leave, borders only, is joined by key: a
    border between two columns is covered on both sides and goes.
    """
    fields = ", ".join(f"{k} {shapes.schema[k].dataType.simpleString()}" for k in keys)
    e = edges(shapes, keys)
    cut = in_columns(e.join(column_width(e, keys, most), keys), F.col("width")).drop("width")

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        """The trapezoids' lower and upper edges, merged along each edge: all that the join of the columns needs."""
        found, running = [], {}
        for x0, x1, pieces in kernel.swept(swept_edges(rows), 1, lambda on: on[0], True):
            now = {}
            for below, above, a, b, c, d in pieces:
                now[below, 1], now[above, -1] = (x0, a, x1, c), (x0, b, x1, d)
            for key in [k for k, v in running.items() if k not in now or v[2] != x0]:
                found.append((*running.pop(key), key[1]))
            for key, v in now.items():
                running[key] = (*running[key][:2], *v[2:]) if key in running else v
        found += [(*v, key[1]) for key, v in running.items()]
        out = pd.DataFrame(found, columns=["x1", "y1", "x2", "y2", "turn"]).astype(float)
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        e = np.column_stack([rows[["x1", "y1", "x2", "y2", "turn"]].to_numpy(float), np.zeros((len(rows), 2))])
        parts = kernel.dissolved_edges(e, True)
        out = [(*[rows[k].iloc[0] for k in keys], i, as_points(o), [as_points(h) for h in holes], kernel.turned_area(o) + sum(map(kernel.turned_area, holes))) for i, (o, holes) in enumerate(parts)]
        return pd.DataFrame(out, columns=[*keys, "part", "outer", "holes", "area"])

    merged = cut.groupBy(*keys, "cx").applyInPandas(borders, f"{fields}, x1 double, y1 double, x2 double, y2 double, turn double")
    return merged.groupBy(*keys).applyInPandas(joined, f"{fields}, part int, outer {RING}, holes array<{RING}>, area double")
