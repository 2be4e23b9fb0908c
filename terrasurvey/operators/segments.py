"""Segments of tiles: clip windows, classes of regions, parcels, and connected or split regions of a tile's pixels."""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import spread
from .masks import rasterised


def clip_window(x0: Column, y0: Column, x1: Column, y1: Column, is_point: Column) -> Column:
    """The window around a click (140 either side) or a drag (80 and half its extent, between 80 and 300)."""
    margin = F.when(is_point, F.lit(140.0)).otherwise(F.least(F.lit(300.0), F.greatest(F.lit(80.0), 80 + 0.5 * F.greatest(x1 - x0, y1 - y0))))
    return F.struct((x0 - margin).alias("x0"), (y0 - margin).alias("y0"), (x1 + margin).alias("x1"), (y1 + margin).alias("y1"))


def region_class(area: Column, aspect: Column, green: Column, hint: Column, by_road: Column) -> Column:
    """struct<label, confidence>: long regions are rows if green, else inter-rows, also under the hint 'waste'; regions by a road are inter-rows."""
    long = F.coalesce(aspect >= 6, F.lit(False)) & (aspect < float("inf"))
    label = F.when(long & (green >= 0.5), "row").when(long | by_road, "interrow_area").when(hint == "waste", "waste").when(green >= 0.5, "vineyard").otherwise("interrow_area")
    confidence = F.when(long, F.least(F.lit(0.95), 0.5 + aspect / 40)).when(hint == "waste", F.lit(0.6)).otherwise(F.least(F.lit(0.9), 0.4 + area / 10_000))
    return F.struct(label.alias("label"), F.round(confidence, 4).alias("confidence"))


def within_parcel(regions: DataFrame, inside: DataFrame, key: str) -> DataFrame:
    """Regions outside every parcel keep half their confidence, and say so."""
    hit = inside.select(key).distinct().withColumn("_in", F.lit(True))
    out = regions.join(hit, key, "left")
    return out.withColumn("confidence", F.when(F.col("_in"), F.col("confidence")).otherwise(F.round(F.col("confidence") / 2, 4))).withColumn("reason", F.when(F.col("_in"), F.lit("")).otherwise("outside parcel")).drop("_in")


def labelled(mask: np.ndarray) -> np.ndarray:
    """4-connected regions of a mask, numbered from 1 in reading order."""
    out, n = np.zeros(mask.shape, np.int32), 0
    for at in zip(*np.nonzero(mask), strict=True):
        if out[at]:
            continue
        n += 1
        out[at], todo = n, [at]
        while todo:
            r, c = todo.pop()
            for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    todo.append(p)
    return out


def watershed(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeds grown over a mask, lowest height first; a pixel goes to the seed that reaches it first."""
    out, queue, n = seeds.copy(), [], 0
    for r, c in zip(*np.nonzero(seeds), strict=True):
        heapq.heappush(queue, (height[r, c], n, r, c))
        n += 1
    while queue:
        _, _, r, c = heapq.heappop(queue)
        for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                out[p] = out[r, c]
                heapq.heappush(queue, (height[p], n, *p))
                n += 1
    return out


def split_instances(pixels: DataFrame, size: int, least: int = 8) -> DataFrame:
    """(tile, instance, pixels) of vine pixels (tile, row, col, vine, edge): seeds are vine without edge, of at least `least` pixels; regions without a seed stay whole.

    A tile has a fixed size, so one group is bounded.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        vine, edge = np.zeros((size, size)), np.zeros((size, size))
        vine[rows["row"], rows["col"]], edge[rows["row"], rows["col"]] = rows["vine"], rows["edge"]
        mask = vine >= 0.5
        seeds = labelled(mask & (edge < 0.5))
        counts = np.bincount(seeds.ravel())
        seeds[np.isin(seeds, np.flatnonzero(counts < least))] = 0
        whole = labelled(mask)
        seeded = np.unique(whole[seeds > 0])
        orphans = mask & ~np.isin(whole, seeded)
        seeds[orphans] = whole[orphans] + seeds.max()
        grown = watershed(edge, seeds, mask)
        ids, n = np.unique(grown[grown > 0], return_counts=True)
        return pd.DataFrame({"tile": rows["tile"].iloc[0], "instance": np.arange(1, len(ids) + 1), "pixels": n})

    return pixels.groupBy("tile").applyInPandas(run, "tile long, instance long, pixels long")


def row_direction(points: DataFrame, keys: list[str], width: float = 0.25) -> DataFrame:
    """(keys, theta): the direction in which points gather most in lines: the sum of squared counts by bins across it, over n squared, is largest.

    Points are counted by cells of a quarter of the bins' width first, so that angles multiply the cells that a block covers and not its points.
    180 whole degrees for every cell, and then tenths of a degree about the best: sums by (key, angle, bin) only, so blocks of any size are shared out.
    """
    size = width / 4
    cell = lambda c: (F.floor(F.col(c) / size + 0.5) * size).alias(c)
    points = points.groupBy(*keys, cell("x"), cell("y")).agg(F.count("*").alias("n"))

    def score(angles: DataFrame) -> DataFrame:
        t = F.radians(F.col("theta"))
        off = F.col("y") * F.cos(t) - F.col("x") * F.sin(t)
        # rounded, so that points on a bin's border fall to one side on every machine
        counts = angles.groupBy(*keys, "theta", F.floor(F.round(off / width, 9)).alias("bin")).agg(F.sum("n").alias("n"))
        sums = counts.groupBy(*keys, "theta").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2)) * (F.max("bin") - F.min("bin") + 1)).alias("score"))
        return sums.groupBy(*keys).agg(F.max_by("theta", F.struct(F.round("score", 9), -F.col("theta"))).alias("theta"))

    coarse = score(points.withColumn("theta", F.explode(F.transform(F.sequence(F.lit(0), F.lit(179)), lambda i: i.cast("double")))))
    fine = points.join(coarse.withColumnRenamed("theta", "about"), keys).withColumn("theta", F.explode(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: F.col("about") + i / 10)))
    return score(fine)


def sampled_grid(boxes: DataFrame, step: float) -> DataFrame:
    """Points at the middles of a grid's cells inside boxes (id, x0, y0, x1, y1)."""
    axis = lambda a, b: F.explode(F.transform(F.sequence(F.ceil(F.col(a) / step - 0.5), F.floor(F.col(b) / step - 0.5)), lambda i: (i + 0.5) * step))
    ok = boxes.where((F.ceil(F.col("x0") / step - 0.5) <= F.floor(F.col("x1") / step - 0.5)) & (F.ceil(F.col("y0") / step - 0.5) <= F.floor(F.col("y1") / step - 0.5)))
    return ok.withColumn("x", axis("x0", "x1")).withColumn("y", axis("y0", "y1"))


def sampled_polygons(shapes: DataFrame, key: str, least: float = 0.25, most: float = 4e6) -> DataFrame:
    """(key, x, y, step): the points of a grid inside each polygon (key, ring, closed), from half a step inside its bounds on.

    The step is `least`, or so much more that the bounds hold `most` points. The grid's lines cross the ring's edges and are paired in order, as masks
    are rasterised, so only points inside are made. Polygons are dealt by key before their edges are cut, and each carries its corner and step along, so that
    neither crossings nor points are moved; a polygon has at most `most` points.
    """
    b = g.bounds(F.col("ring"))
    sized = spread(shapes.select(key, "ring", b.alias("b")), key).withColumn("step", F.greatest(F.lit(least), F.sqrt((F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0")) / most)))
    scaled = F.transform("ring", lambda p: F.struct(((p["x"] - F.col("b.x0")) / F.col("step")).alias("x"), ((p["y"] - F.col("b.y0")) / F.col("step")).alias("y")))
    runs = rasterised(sized.select(key, F.col("b.x0").alias("_x0"), F.col("b.y0").alias("_y0"), "step", F.array(scaled).alias("rings")), [key, "_x0", "_y0", "step"])
    at = lambda c, low: ((F.col(c) + 0.5) * F.col("step") + F.col(low))
    return runs.withColumn("px", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).select(key, at("px", "_x0").alias("x"), at("py", "_y0").alias("y"), "step")
