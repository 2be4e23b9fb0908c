"""Polylines against areas and brushes: the pieces outside areas, and what an eraser leaves."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geometry as g
from .spatial import box_join, mean_extent

LOW_HIGH = (("x0", F.least, "x"), ("y0", F.least, "y"), ("x1", F.greatest, "x"), ("y1", F.greatest, "y"))


def segments_of(lines: DataFrame, key: str) -> DataFrame:
    """(key, segment, a, b, x0, y0, x1, y1): the segments of lines (key, points) in order, those walked twice as often as they are walked."""
    s = lines.select(key, F.posexplode(g.pairs(F.col("points"))).alias("segment", "s")).select(key, "segment", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    return s.select("*", *[f(f"a.{c}", f"b.{c}").alias(n) for n, f, c in LOW_HIGH])


#: At most so many areas, of so many points in all, are sent to every task, so that the lines stay where they are.
SENT = (64, 50_000)
#: Edges compared at once, so that a batch with large rings takes no more memory.
AT_ONCE = 1 << 20


def chunks(sizes: np.ndarray):
    """(from, to): ranges of rows whose sizes add up to AT_ONCE, or of one row that is larger."""
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, to
        at = to


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places starts[i], starts[i] + 1, ... of each row i, sizes[i] of them."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def inside_shares(a: np.ndarray, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): the shares of segments a to b that lie inside a closed ring each, which is rings[starts[i]] and the sizes[i] edges that follow.

    A segment is cut where it meets an edge, at its ends where an edge lies along it; a part is inside if the ring holds its middle, and borders are inside.
    """
    cut_row, cut = [np.repeat(np.arange(len(a)), 2)], [np.tile([0.0, 1.0], len(a))]
    for low, high in chunks(sizes):
        row, at = ragged(starts[low:high], sizes[low:high])
        row += low
        d, e, w = b[row] - a[row], rings[at + 1] - rings[at], rings[at] - a[row]
        det, off, size = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0], w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0], (d * d).sum(axis=1)
        flat = det == 0
        along = flat & (np.abs(off) <= 1e-9 * np.sqrt(size)) & (size > 0)
        det[flat] = np.nan
        t, u = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / det, off / det
        crossed = (u >= -1e-12) & (u <= 1 + 1e-12)
        cut_row += [row[crossed], row[along], row[along]]
        cut += [t[crossed], (w * d).sum(axis=1)[along] / size[along], ((w + e) * d).sum(axis=1)[along] / size[along]]
    row, t = np.concatenate(cut_row), np.concatenate(cut)
    keep = (t >= 0) & (t <= 1)
    row, t = row[keep], t[keep]
    order = np.lexsort((t, row))
    row, t = row[order], t[order]
    part = np.flatnonzero((row[1:] == row[:-1]) & (t[1:] - t[:-1] > 1e-12))
    row, first, last = row[part], t[part], t[part + 1]
    middle = a[row] + (b[row] - a[row]) * ((first + last) / 2)[:, None]
    inside = np.zeros(len(row), bool)
    for low, high in chunks(sizes[row]):
        n, at = ragged(starts[row[low:high]], sizes[row[low:high]])
        m, p, q = middle[n + low], rings[at], rings[at + 1]
        e, w = q - p, m - p
        rise, size = np.where(e[:, 1] == 0, 1.0, e[:, 1]), (e * e).sum(axis=1)
        crosses = ((p[:, 1] > m[:, 1]) != (q[:, 1] > m[:, 1])) & (m[:, 0] < e[:, 0] * w[:, 1] / rise + p[:, 0])
        place = np.clip((w * e).sum(axis=1) / np.where(size == 0, 1.0, size), 0, 1)
        near = np.hypot(*(w - place[:, None] * e).T) <= 1e-9
        inside[low:high] = (np.bincount(n[crosses], minlength=high - low) % 2 == 1) | (np.bincount(n[near], minlength=high - low) > 0)
    return row[inside], first[inside], last[inside]


def shares_of(batches):
    """Batches with columns ax, ay, bx, by and r_ring, and others, which are kept: a row for each share of the segment inside the ring, as from and to."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        a, b = (np.stack([t[f"{p}{c}"].to_numpy() for c in "xy"], axis=1) for p in "ab")
        ring = t["r_ring"].combine_chunks()
        points, sizes = ring.flatten(), ring.value_lengths().to_numpy()
        xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)
        row, first, last = inside_shares(a, b, np.cumsum(sizes, dtype=np.int64) - sizes, np.maximum(sizes - 1, 0), xy)
        kept = t.drop_columns(["ax", "ay", "bx", "by", "r_ring"]).take(pa.array(row))
        yield from kept.append_column("from", pa.array(first)).append_column("to", pa.array(last)).combine_chunks().to_batches()


def pieces_outside(lines: DataFrame, areas: DataFrame, key: str, least: float = 1e-9) -> DataFrame:
    """(key, segment, piece, from, to, length_m): the pieces of lines (key, points) outside the union of areas (ring, closed), as shares of their segment.

    Each segment meets the areas whose bounds overlap it, also those along the diagonals, in the cells of a grid; what lies inside each of them is worked out
    for a batch at once, and the pieces outside are the gaps between these shares. Few areas are sent to all tasks, so that lines that lie in few cells don't
    gather in few tasks. Repeated segments count as often as they are walked; lines of any length are shared out by segment.
    """
    spans = lambda low, high: [F.least(low, high), F.greatest(low, high)]
    s = segments_of(lines, key)
    u, v = spans(F.col("a.x") + F.col("a.y"), F.col("b.x") + F.col("b.y")), spans(F.col("a.x") - F.col("a.y"), F.col("b.x") - F.col("b.y"))
    s = s.select(key, "segment", *[F.col(f"{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"], "x0", "y0", "x1", "y1", *[c.alias(n) for c, n in zip([*u, *v], ("u0", "u1", "v0", "v1"), strict=True)])
    sums, differences = F.transform("ring", lambda p: p["x"] + p["y"]), F.transform("ring", lambda p: p["x"] - p["y"])
    along = [F.array_min(sums).alias("u0"), F.array_max(sums).alias("u1"), F.array_min(differences).alias("v0"), F.array_max(differences).alias("v1")]
    r = areas.select("ring", g.bounds(F.col("ring")).alias("b"), *along).select("ring", "b.*", "u0", "u1", "v0", "v1")
    few = areas.agg(F.count("*"), F.coalesce(F.sum(F.size("ring")), F.lit(0))).first()
    near = lambda n: (F.col(f"{n}0") <= F.col(f"r_{n}1") + 1e-9) & (F.col(f"r_{n}0") <= F.col(f"{n}1") + 1e-9)
    if few[0] <= SENT[0] and few[1] <= SENT[1]:
        sent = F.broadcast(r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns]))
        met = s.join(sent, near("x") & near("y") & near("u") & near("v"))
    else:
        met = box_join(s, r, max(mean_extent(s), mean_extent(r) / 16), reach=1e-9).where(near("u") & near("v"))
    metres = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("metres")
    met = met.select(key, "segment", metres, "ax", "ay", "bx", "by", "r_ring")
    kept = StructType([*met.schema.fields[:3], StructField("from", DoubleType()), StructField("to", DoubleType())])
    ends = s.select(key, "segment", metres, F.lit(1.0).alias("from"), F.lit(1.0).alias("to"))
    order = Window.partitionBy(key, "segment").orderBy("from", "to")
    # what lies before a share, or before the segment's end, and after all that came first
    gaps = met.mapInArrow(shares_of, kept).unionByName(ends).withColumn("_seen", F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    gaps = gaps.where((F.col("from") > F.col("_seen") + 1e-12) & ((F.col("from") - F.col("_seen")) * F.col("metres") > least))
    out = gaps.withColumn("piece", (F.row_number().over(order) - 1).cast("long"))
    return out.select(key, "segment", "piece", F.col("_seen").alias("from"), F.col("from").alias("to"), ((F.col("from") - F.col("_seen")) * F.col("metres")).alias("length_m"))


def brushed(lines: DataFrame, discs: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, piece, points): what an eraser leaves of lines (key, points): runs of two points or more that no disc (x, y) of the radius covers.

    Lines get points at every max(0.5, radius / 3) at most besides their own; points and discs meet in cells, whatever the lines' directions.
    """
    s = segments_of(lines, key)
    n = F.greatest(F.ceil(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) / max(0.5, radius / 3)), F.lit(1))
    last = F.col("segment") == F.max("segment").over(Window.partitionBy(key))
    s = s.withColumn("n", n).withColumn("last", last)
    at = s.select(key, "segment", "a", "b", "n", F.explode(F.sequence(F.lit(0), F.when(F.col("last"), F.col("n")).otherwise(F.col("n") - 1))).alias("i"))
    place = [(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("i") / F.col("n")).alias(c) for c in "xy"]
    p = at.select(key, "segment", "i", *place)
    points = p.select("*", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    d = discs.select("x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    covered = box_join(points, d, 2 * radius, reach=radius).where(F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")) <= radius).select(key, "segment", "i").distinct()
    order = Window.partitionBy(key).orderBy("segment", "i")
    # points are many more than their lines' bytes tell, so those covered are not to be broadcast
    marked = p.join(covered.withColumn("gone", F.lit(True)).hint("merge"), [key, "segment", "i"], "left").withColumn("piece", F.count("gone").over(order)).where("gone is null")
    out = marked.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("segment", "i", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    return out.select(key, "piece", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
