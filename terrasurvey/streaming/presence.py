"""Presence and locks of tiles: a stream of events folded by tile, and batch forms of the same rules."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranges import in_ranges

#: A holder or client that has not been heard of for longer than this many seconds is gone.
TTL = 20.0


def step(holder: tuple[str, float] | None, kind: str, client: str, at: float, ttl: float) -> tuple[tuple[str, float] | None, bool]:
    """(holder, accepted) after one event. A heartbeat takes a free lock and keeps an own one, but never steals; only the holder can release."""
    if holder and at - holder[1] > ttl:
        holder = None
    if kind in ("claim", "heartbeat"):
        if holder is None or holder[0] == client:
            return (client, at), True
        return holder, False
    if kind == "release":
        return (None, True) if holder and holder[0] == client else (holder, False)
    if kind in ("force_release", "verified", "invalid"):
        return None, holder is not None
    return holder, False


def fold(rows: pd.DataFrame, holder: tuple[str, float] | None, ttl: float) -> tuple[pd.DataFrame, tuple[str, float] | None]:
    out = []
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        holder, ok = step(holder, r.kind, r.client, r.at, ttl)
        out.append((r.tile, r.event_id, ok, holder[0] if holder else None))
    return pd.DataFrame(out, columns=["tile", "event_id", "accepted", "holder"]), holder


FIELDS = "tile long, event_id long, accepted boolean, holder string"


def lock_stream(events: DataFrame, ttl: float = TTL) -> DataFrame:
    """Of a stream of (tile, event_id, kind, client, at): whether each event was accepted, and who holds the tile's lock after it.

    State is one holder for each tile, and goes when nothing was heard of the tile for longer than the TTL.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        client, at = state.get if state.exists else (None, 0.0)
        out, holder = fold(pd.concat(list(batches)), (client, at) if client else None, ttl)
        if holder:
            state.update(holder)
            state.setTimeoutDuration(int(ttl * 1000) + 1)
        elif state.exists:
            state.remove()
        yield out

    return events.groupBy("tile").applyInPandasWithState(run, FIELDS, "client string, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def lock_history(events: DataFrame, ttl: float = TTL, most: int = 100_000) -> DataFrame:
    """The same for a table of events. A tile's events may take many tasks: they are cut into ranges of about `most` events in order of time.

    What a range does to a lock is a map from the holder before it to the holder after it. Who held the lock has been heard of within the TTL, and
    holds it since its last event, so only few holders are possible before a range: nobody, or one of the clients heard of shortly before. Each range is
    folded for each of them (until that comes to the same as for nobody), the maps of a tile's ranges are applied in order, a few
    rows for each range, and each range is folded again from the holder that it begins with.
    """
    rows = in_ranges(events.select("tile", "event_id", "kind", "client", "at"), "tile", "at", "event_id", most=most)
    spans = rows.groupBy("tile", "_range").agg(F.min("at").alias("since"))
    # only tiles in several ranges have a later one; there are fewer of those than ranges
    later = spans.withColumn("_first", F.min("_range").over(Window.partitionBy("tile"))).where("_range > _first").select("tile", F.col("_range").alias("_later"), "since")
    heard = rows.where(F.col("kind").isin("claim", "heartbeat")).join(later, "tile").where((F.col("_range") < F.col("_later")) & (F.col("since") - F.col("at") <= ttl))
    heard = heard.groupBy(F.col("tile").alias("tile"), F.col("_later").alias("_range"), F.col("client").alias("client")).agg(F.max("at").alias("at"))
    own, kind = ["tile", "_range"], "tile long, _range long"

    def follow(part: pd.DataFrame, possible: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "event_id"])
        turns = list(zip(part["kind"], part["client"], part["at"], strict=True))
        trace, holder = [], None
        for event in turns:
            holder = step(holder, *event, ttl)[0]
            trace.append(holder)
        maps = [(None, None, *(holder or (None, None)))]
        for client, at in zip(possible["client"], possible["at"], strict=True):
            now = (client, at)
            for event, plain in zip(turns, trace, strict=True):
                now = step(now, *event, ttl)[0]
                if now == plain:
                    now = holder
                    break
            maps.append((client, at, *(now or (None, None))))
        out = pd.DataFrame(maps, columns=["client", "at", "to", "to_at"])
        return out.assign(tile=part["tile"].iloc[0], _range=part["_range"].iloc[0])[["tile", "_range", "client", "at", "to", "to_at"]] if len(part) else out.iloc[:0].assign(tile=0, _range=0)[["tile", "_range", "client", "at", "to", "to_at"]]

    def chain(maps: pd.DataFrame) -> pd.DataFrame:
        out, holder = [], (None, None)
        for at, span in maps.groupby("_range", sort=True):
            out.append((span["tile"].iloc[0], at, *holder))
            known = {None if pd.isna(c) else c: (None, None) if pd.isna(t) else (t, w) for c, t, w in zip(span["client"], span["to"], span["to_at"], strict=True)}
            holder = known.get(holder[0], known[None])  # who is not among them has not been heard of for too long
        return pd.DataFrame(out, columns=["tile", "_range", "client", "at"])

    split = rows.join(later.select("tile").distinct(), "tile", "left_semi")
    maps = split.groupBy(*own).cogroup(heard.groupBy(*own)).applyInPandas(follow, f"{kind}, client string, at double, to string, to_at double")
    begins = maps.groupBy("tile").applyInPandas(chain, f"{kind}, client string, at double")

    def run(part: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        client = begin["client"].iloc[0] if len(begin) else None
        return fold(part, None if pd.isna(client) else (client, begin["at"].iloc[0]), ttl)[0]

    return rows.groupBy(*own).cogroup(begins.groupBy(*own)).applyInPandas(run, FIELDS)


def sessions(events: DataFrame, ttl: float) -> DataFrame:
    """(client, first, last, n): stretches of a client's heartbeats without a silence of more than ttl seconds."""
    order = Window.partitionBy("client").orderBy("at", "event_id")
    starts = F.when(F.col("at") - F.lag("at").over(order) > ttl, 1).otherwise(0)
    run = F.sum("_starts").over(order)
    return events.withColumn("_starts", starts).withColumn("_run", run).groupBy("client", "_run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("_run")


def snapshot(events: DataFrame, now, ttl: float) -> DataFrame:
    """(client, tile, idle_secs) of clients heard of within ttl seconds before now."""
    last = events.where(F.col("at") <= now).groupBy("client").agg(F.max(F.struct("at", "event_id", "tile")).alias("l"))
    return last.where(now - F.col("l.at") <= ttl).select("client", F.col("l.tile").alias("tile"), F.round(now - F.col("l.at"), 3).alias("idle_secs"))


def coalesced_saves(changes: DataFrame, quiet: str = "1200 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(doc, saved_at, n): a save for each run of changes of a document, once nothing changed for the quiet time. For streams and tables."""
    w = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return w.groupBy("doc", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n")).select("doc", F.col("w.end").alias("saved_at"), "n")


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by sliding window and kind; late ones count up to the watermark. (An addition for streams; ts must be a timestamp.)"""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "kind").agg(F.count("*").alias("n"))
