"""The label store: tiles, their status and locks, annotations, and the exports and updates made of them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, stored
from .ranges import in_ranges, running

STATUSES = ("unchecked", "in_progress", "verified", "invalid")


def tile_board(tiles: DataFrame, statuses: DataFrame, annotations: DataFrame, locks: DataFrame) -> DataFrame:
    """Every tile with its status ('unchecked' if it has none), number of labels and lock holder."""
    counts = annotations.groupBy("tile_name").agg(F.count("*").alias("n_labels"))
    out = tiles.join(statuses, "name", "left").join(counts, tiles.name == counts.tile_name, "left").join(locks.withColumnRenamed("tile_name", "lock_tile"), F.col("name") == F.col("lock_tile"), "left")
    return out.select("name", F.coalesce("verification_status", F.lit("unchecked")).alias("status"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "updated_by", "locked_by")


def status_counts(board: DataFrame) -> DataFrame:
    """One row for each of the four states, with 0 where no tile has it."""
    spark = board.sparkSession
    return spark.createDataFrame([(s,) for s in STATUSES], "status string").join(board.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def progress(board: DataFrame) -> DataFrame:
    """(total, verified, percent): per cent with two decimals, 0 without tiles."""
    total, done = F.count("*"), F.count_if(F.col("status") == "verified")
    return board.agg(total.alias("total"), done.alias("verified"), F.when(total > 0, F.round(100.0 * done / total, 2)).otherwise(F.lit(0.0)).alias("percent"))


def exported(tiles: DataFrame, statuses: DataFrame, annotations: DataFrame) -> DataFrame:
    """Tiles to export (annotated or invalid) with their annotations; an invalid tile keeps its row but has no labels."""
    invalid = statuses.where("verification_status = 'invalid'").select("name")
    chosen = annotations.select(F.col("tile_name").alias("name")).union(invalid).distinct().join(tiles, "name", "left_semi")
    labels = annotations.join(invalid, F.col("tile_name") == F.col("name"), "left_anti").groupBy("tile_name").agg(F.count("*").alias("n_labels"), F.max("id").alias("last_id"))
    return chosen.join(labels, F.col("name") == F.col("tile_name"), "left").select("name", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "last_id")


def in_view(board: DataFrame, user: str) -> DataFrame:
    """The board with flags of the work views: done, invalid, mine, queue."""
    free = F.coalesce(F.col("locked_by") == user, F.lit(True))
    mine = F.coalesce(F.col("locked_by") == user, F.lit(False)) | ((F.col("status") == "in_progress") & F.coalesce(F.col("updated_by") == user, F.lit(False)))
    return board.select("name", (F.col("status") == "verified").alias("done"), (F.col("status") == "invalid").alias("invalid"), mine.alias("mine"), (~F.col("status").isin("verified", "invalid") & free).alias("queue"))


def sorted_tiles(board: DataFrame, by_status: bool) -> DataFrame:
    """Tiles numbered by name, or by the rank of their status and then name: sorted in ranges, and numbered by the ranges' sizes added up."""
    rank = F.array_position(F.array(*map(F.lit, ("in_progress", "unchecked", "verified", "invalid"))), F.col("status")) if by_status else F.lit(0)
    ranged = in_ranges(board.select("name", "status", rank.alias("rank"), F.lit(1).alias("one")), "rank", "name")
    return running(ranged, place="one").select("name", "status", F.col("place").cast("int").alias("place"))


def enough_points(annotations: DataFrame) -> DataFrame:
    """Shapes with the vertices they need: polygons 3, polylines and boxes 2."""
    return annotations.where(F.col("n_points") >= F.when(F.col("shape_type") == "polygon", 3).otherwise(2))


def insert_missing(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with those new rows whose key it lacks."""
    return store.unionByName(new.join(store, key, "left_anti"))


def replace_partition(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with all rows of the keys in `new` replaced by the new ones. (On files: dynamic partition overwrite.)"""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def patch(store: DataFrame, changes: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """The store with fields changed where a change is not null, and without deleted keys. A field can't be set to null."""
    kept = store.join(deletions, key, "left_anti")
    fields = [c for c in store.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields if c in changes.columns])
    return kept.join(new, key, "left").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields])


def derived_label(label: Column, prompt: Column, suffix: Column, prompts: dict[str, str], suffixes: dict[str, str]) -> Column:
    """A feature's label: its own, else by its prompt, else by its file's suffix, else null."""
    lookup = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    own = F.nullif(F.trim(label), F.lit(""))
    return F.coalesce(own, F.try_element_at(lookup(prompts), F.lower(F.trim(prompt))), F.try_element_at(lookup(suffixes), F.lower(suffix)))


def import_summary(features: DataFrame) -> DataFrame:
    """(label, n) of imported features; null counts those that are skipped."""
    return features.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("tile").alias("n_tiles"))


def next_fit(files: DataFrame, limit: int) -> DataFrame:
    """Files, by name, put into parts of at most `limit` bytes: a new part opens when the next file doesn't fit an unempty one.

    Running sums tell for each file where the next part would begin if one began here: the first later file whose end is more than `limit` past this
    one's beginning. It is looked up in cells of `limit` bytes. Pointers along these jumps, doubled each round, find the
    files that parts begin with, in as many rounds as the number of parts has bits; no task has all files.
    """
    order = in_ranges(files.select("name", "size_bytes"), "name", "size_bytes").withColumn("_one", F.lit(1))
    rows = running(order, end="size_bytes", place="_one").withColumn("begin", F.col("end") - F.col("size_bytes"))
    rows = stored(rows.select("name", "size_bytes", "begin", "end", "place"))
    cell = lambda c: F.floor(c / limit)
    ends = rows.select(cell(F.col("end")).alias("cell"), F.col("end").alias("at"), F.lit(0).alias("asks"), "place", "begin")
    asked = rows.select(cell(F.col("begin") + limit).alias("cell"), (F.col("begin") + limit).alias("at"), F.lit(1).alias("asks"), "place", "begin")
    # from the far end of a cell: what was met last before a question ends later, and first of those; a file that ends just there still fits
    later = Window.partitionBy("cell").orderBy(F.desc("at"), F.desc("asks"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    file = F.when(F.col("asks") == 0, F.struct("place", F.col("begin").alias("from")))
    near = ends.unionByName(asked).withColumn("hit", F.last(file, ignorenulls=True).over(later))
    over = rows.select(F.explode(F.sequence(cell(F.col("begin")), F.greatest(cell(F.col("begin")), cell(F.col("end")) - 1))).alias("cell"), F.struct("place", F.col("begin").alias("from")).alias("out"), "end")
    over = over.where(cell(F.col("end")) > F.col("cell")).groupBy("cell").agg(F.min("out").alias("out"))
    found = near.where("asks = 1").join(over, "cell", "left").withColumn("hit", F.coalesce("hit", "out"))
    # a file that is too large by itself fills the part that it begins
    jumps = found.select("place", F.when(F.col("hit.from") > F.col("begin"), F.col("hit.place")).otherwise(F.col("hit.place") + 1).alias("to"))
    starts = part_starts(jumps, rows.agg(F.max("place")).first()[0])
    rows = in_ranges(rows.join(starts, "place", "left").withColumn("_new", F.when(F.col("part").isNotNull(), 1).otherwise(0)), "place")
    return running(rows.drop("part"), part="_new").select("name", "size_bytes", F.col("part").cast("int").alias("part"))


def part_starts(jumps: DataFrame, last: int | None) -> DataFrame:
    """(place, part): the places that jumps (place, to) lead to from place 1, and how many jumps that takes, from 1."""
    hop = stored(jumps.where(F.col("to") <= F.lit(last or 0)))
    found = stored(jumps.sparkSession.range(1, 2).select(F.col("id").alias("place"), F.lit(1).cast("long").alias("part")).where(F.lit(last is not None)))
    step = 1
    while True:
        new = stored(found.join(hop, "place").select(F.col("to").alias("place"), (F.col("part") + step).alias("part")))
        if new.isEmpty():
            return found
        onward = hop.select(F.col("place").alias("to"), F.col("to").alias("on"))
        before, hop = hop, stored(hop.join(onward, "to").select("place", F.col("on").alias("to")))
        forget(before)
        before, found = found, stored(found.unionByName(new))
        forget(before)
        step *= 2


def latest_locks(events: DataFrame) -> DataFrame:
    """(tile_name, locked_by): who last touched each tile."""
    return events.groupBy("tile_name").agg(F.max_by("client", F.struct("at", "client")).alias("locked_by"))
