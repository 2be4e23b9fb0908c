"""Pixel tables: overlay by priority, histograms, thresholds and statistics."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread

#: Burn order of the label classes; classes not named are left out.
PRIORITY = ("vineyard", "interrow_area", "waste", "row")


def rank_of(label: str) -> Column:
    """A label's place in the burn order; null for labels that are not burnt."""
    return F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(label)), F.lit(0))


def burn(pixels: DataFrame, place: list[str], order: str) -> DataFrame:
    """The label that each pixel ends up with: classes burn by priority, then in the given order; later ones overwrite. Other labels are left out."""
    return pixels.where(rank_of("label").isNotNull()).groupBy(*place).agg(F.max_by("label", F.struct(rank_of("label"), order)).alias("label"))


def complete(batches, group: list[str]):
    """Data frames sorted by `group`, dealt anew so that the rows of a group come together; a null is a value like others."""
    kept = None
    for rows in batches:
        rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
        if not len(rows):
            continue
        last = np.ones(len(rows), bool)
        for c in group:
            codes = pd.factorize(rows[c], use_na_sentinel=False)[0]
            last &= codes == codes[-1]
        at = int(np.argmax(last))
        if at:
            yield rows.iloc[:at].reset_index(drop=True)
        kept = rows.iloc[at:].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept


def painted(group: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, by: np.ndarray, most: int = 1 << 22) -> tuple:
    """(group, start, end, rank) of the pieces between neighbouring ends of runs, of which later runs, `by` being their order, overwrite earlier ones."""
    places = np.unique(np.concatenate((start, end)))
    n = len(places)
    a, b = group * n + np.searchsorted(places, start), group * n + np.searchsorted(places, end)
    ends = np.unique(np.concatenate((a, b)))
    first, last = np.searchsorted(ends, a)[by], np.searchsorted(ends, b)[by]
    top, colour = np.zeros(len(ends), np.int64), rank[by]
    size = np.maximum(last - first, 0)
    done = np.cumsum(size)
    at = 0
    while at < len(by):  # so many pieces at once
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        some = size[at:to]
        pieces = np.repeat(first[at:to] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        top[pieces] = np.repeat(colour[at:to], some)  # of equal places the last one holds
        at = to
    hit = np.flatnonzero(top)
    return ends[hit] // n, places[ends[hit] % n], places[ends[hit + 1] % n] if len(hit) else places[:0], top[hit]


def burnt_runs(runs: DataFrame, keys: list[str], line: str, order: str, dealt: bool = False) -> DataFrame:
    """(keys, line, start, end, label): what runs of pixels (from start, before end) on each line look like when all are burnt.

    Between two neighbouring ends of runs nothing changes, so only these pieces are judged, not pixels: the work follows the number of runs on a
    line and not how long they are. dealt: runs are in partitions by keys, sorted by them, and stay there; else they are dealt by keys and line.
    """
    known = runs.where(rank_of("label").isNotNull()).select(*keys, line, F.col("start").cast("long"), F.col("end").cast("long"), rank_of("label").alias("_rank"), F.col(order).alias("_order"))
    group = keys if dealt else [*keys, line]
    known = known if dealt else spread(known, *group).sortWithinPartitions(*group)

    def run(batches):
        for rows in complete(batches, group):
            codes = np.zeros(len(rows), np.int64)
            for c in [*keys, line]:
                more = pd.factorize(rows[c], use_na_sentinel=False)[0]
                codes = np.unique(codes * (more.max() + 1) + more, return_inverse=True)[1]
            by = rows[["_rank", "_order"]].sort_values(["_rank", "_order"], na_position="first").index.to_numpy()
            of, start, end, top = painted(codes, *(rows[c].to_numpy(np.int64) for c in ("start", "end", "_rank")), by)
            names = rows[[*keys, line]].iloc[np.unique(codes, return_index=True)[1]].iloc[of].reset_index(drop=True)
            yield names.assign(start=start, end=end, label=np.array(PRIORITY, object)[top - 1])

    fields = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in [*keys, line])
    return known.mapInPandas(run, f"{fields}, start long, end long, label string")


def vegetation_index(r: Column, g: Column, b: Column) -> Column:
    """Excess green on chromaticity: (2g - r - b) / (r + g + b); null where the pixel is black."""
    total = r + g + b
    return F.when(total > 0, (2 * g - r - b) / total)


def histogram(values: DataFrame, value: str, low: float, width: float) -> DataFrame:
    return values.groupBy(F.floor((F.col(value) - low) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def otsu(values: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """(key, threshold) that parts each key's values best into two classes.

    Finite values are counted in `bins` equal bins between their minimum and maximum; the threshold is the middle of the first bin for which the
    variance between the two classes is largest. Constant values give that value; keys without finite values give -1. Only
    counts by bin are gathered, at most `bins` rows for each key.
    """
    finite = values.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    ends = finite.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = finite.join(ends, key).where("hi > lo").groupBy(key, "lo", "hi", at.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    middle = F.col("bin") + 0.5
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("bin")
    s = counts.select("*", F.sum("n").over(upto).alias("w0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * middle).over(upto).alias("m0"), F.sum(F.col("n") * middle).over(whole).alias("m"))
    between = F.when(F.col("w") > F.col("w0"), F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / (F.col("w") - F.col("w0")), F.lit(2.0))).otherwise(0.0)
    best = s.withColumn("v", F.round(between, 6)).groupBy(key, "lo", "hi").agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("bin"))
    found = best.select(key, (F.col("lo") + (F.col("bin") + 0.5) / bins * (F.col("hi") - F.col("lo"))).alias("threshold"))
    flat = ends.where("hi = lo").select(key, F.col("lo").cast("double").alias("threshold"))
    none = values.select(key).distinct().join(ends, key, "left_anti").select(key, F.lit(-1.0).alias("threshold"))
    return found.unionByName(flat).unionByName(none)


def cover_class(index: Column, limit: float = 0.05, bare: float = 0.2, full: float = 0.6) -> Column:
    """Ground cover by the share of pixels over the limit; an aggregate expression."""
    share = F.avg(F.when(index.isNotNull(), (index > limit).cast("double")))
    return F.when(share.isNull(), "unassessable").when(share < bare, "bare_soil").when(share >= full, "vegetation").otherwise("mixed")


def window_starts(extent: int, window: int, step: int) -> list[int]:
    """Evenly spread starts of sliding windows that cover the extent."""
    if extent <= window:
        return [0]
    n = -(-(extent - window) // step) + 1
    return [round(i * (extent - window) / (n - 1)) for i in range(n)]


def blended(scores: DataFrame, place: list[str], score: str, weight: str) -> DataFrame:
    """Overlapping windows' scores as their weighted mean."""
    return scores.groupBy(*place).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("score"))


def window_weights(window: int):
    """How much a window's pixels count along one axis: least at its ends, all from a quarter on."""
    import numpy as np

    i = np.arange(window)
    return np.clip(np.minimum(i + 1, window - i) / (window / 4), 0.05, 1.0)


def slid(pixels: DataFrame, keys: list[str], width: int, height: int, window: int, overlap: int, score) -> DataFrame:
    """(keys, px, py, score): windows that slide over tiles of a width and height, scored, and blended where they overlap.

    pixels: keys, px, py, value; those without a value are 0. score: a function of a window's image (rows, columns) that gives as many scores; it is asked
    for the image and for the image mirrored along each axis, and the three answers' mean counts. A window is one group, of fixed size.
    """
    import numpy as np
    import pandas as pd

    starts = [window_starts(n, window, window - overlap) for n in (width, height)]
    of = lambda c, s: F.explode(F.filter(F.array(*map(F.lit, s)), lambda x: (x <= F.col(c)) & (F.col(c) < x + window)))
    dealt = pixels.select(*keys, "px", "py", "value").withColumn("sx", of("px", starts[0])).withColumn("sy", of("py", starts[1]))
    fields = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    weight = np.outer(window_weights(window), window_weights(window))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = int(rows["sx"].iloc[0]), int(rows["sy"].iloc[0])
        image = np.zeros((window, window))
        image[rows["py"] - y, rows["px"] - x] = rows["value"].fillna(0.0)
        found = (score(image) + score(image[:, ::-1])[:, ::-1] + score(image[::-1])[::-1]) / 3
        j, i = np.divmod(np.arange(window * window), window)
        out = pd.DataFrame({"px": i + x, "py": j + y, "found": found.ravel(), "weight": weight.ravel()})
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out[(out["px"] < width) & (out["py"] < height)]

    scores = dealt.groupBy(*keys, "sx", "sy").applyInPandas(run, f"{fields}, px long, py long, found double, weight double")
    return blended(scores, [*keys, "px", "py"], "found", "weight")
