"""Measurements of blocks, rows and the whole survey, and its summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): the stretches that intervals [a, b] of each key cover together.

    Both windows take the rows of one sort, so equal pieces stand in one order in both and lie in one stretch.
    """
    seen = F.max("b").over(Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seen.isNull() | (F.col("a") > seen), 1).otherwise(0)
    stretch = F.sum("opens").over(Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("opens", opens).withColumn("stretch", stretch).groupBy(*keys, "stretch").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("stretch")


def structure_vote(structure: str = "row_structure") -> Column:
    """'disrupted' if any piece is, else the most frequent value, ties to the first by name; an aggregate expression."""
    return F.when(F.bool_or(F.col(structure) == "disrupted"), "disrupted").otherwise(F.mode(structure, deterministic=True))


def row_lengths(pieces: DataFrame) -> DataFrame:
    """(vineyard_id, row_id, row_length_m, row_structure): coincident pieces count once."""
    lengths = covered(pieces, ["vineyard_id", "row_id"]).groupBy("vineyard_id", "row_id").agg(F.sum(F.col("last") - F.col("first")).alias("row_length_m"))
    votes = pieces.groupBy("vineyard_id", "row_id", "row_structure").agg(F.count("*").alias("n"))
    best = votes.groupBy("vineyard_id", "row_id").agg(F.bool_or(F.col("row_structure") == "disrupted").alias("any"), F.min_by("row_structure", F.struct(-F.col("n"), "row_structure")).alias("mode"))
    return lengths.join(best, ["vineyard_id", "row_id"]).select("vineyard_id", "row_id", "row_length_m", F.when(F.col("any"), "disrupted").otherwise(F.col("mode")).alias("row_structure"))


def box_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area): the area that axis-parallel integer boxes (x, y, w, h) cover together, by unit columns and covered stretches of each."""
    columns = boxes.withColumn("column", F.explode(F.sequence("x", F.col("x") + F.col("w") - 1))).select(*keys, "column", F.col("y").alias("a"), (F.col("y") + F.col("h")).alias("b"))
    return covered(columns, [*keys, "column"]).groupBy(*keys).agg(F.sum(F.col("last") - F.col("first")).alias("area"))


def measurements(pieces: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines of three levels, 'total', 'block' and 'row', rounded last.

    Blocks are those that have canopy or rows. Totals are not sums of blocks: total canopy is that of all boxes, also without a block; total
    inter-row area and row length leave pieces without a block out, but the number of rows counts them.
    """
    named = lambda df: df.where("vineyard_id is not null and vineyard_id != ''")
    rows = row_lengths(pieces)
    canopy, lanes = boxes.where("label = 'vineyard'"), boxes.where("label = 'interrow_area'")
    by_block = named(rows).groupBy("vineyard_id").agg(F.count("*").alias("row_count"), F.sum("row_length_m").alias("row_length_m"), F.bool_or(F.col("row_structure") == "disrupted").alias("any"))
    canopy_of = box_area(named(canopy), ["vineyard_id"]).withColumnRenamed("area", "canopy_area_m2")
    lanes_of = box_area(named(lanes), ["vineyard_id"]).withColumnRenamed("area", "interrow_area_m2")
    blocks = by_block.join(canopy_of, "vineyard_id", "full").join(lanes_of, "vineyard_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.lit(None).cast("string")
    out = blocks.select(F.lit(1).alias("rank"), F.lit("block").alias("level"), "vineyard_id", none.alias("row_id"), none.alias("row_structure"), zero("row_count").alias("row_count"), zero("row_length_m").cast("double").alias("row_length_m"), zero("canopy_area_m2").cast("double").alias("canopy_area_m2"), zero("interrow_area_m2").cast("double").alias("interrow_area_m2"), F.lit(None).cast("long").alias("block_count"))
    lines = named(rows).select(F.lit(2), F.lit("row"), "vineyard_id", "row_id", "row_structure", F.lit(None).cast("long"), "row_length_m", F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("long"))
    one = lambda df, c: box_area(df.withColumn("all", F.lit(1)), ["all"]).select("all", F.col("area").alias(c))
    length = rows.groupBy().agg(F.lit(1).alias("all"), F.count("*").alias("row_count"), F.coalesce(F.sum(F.when(F.col("vineyard_id") != "", F.col("row_length_m"))), F.lit(0.0)).alias("row_length_m"))
    n_blocks = blocks.groupBy().agg(F.lit(1).alias("all"), F.count("*").alias("block_count"))
    total = length.join(one(canopy, "canopy_area_m2"), "all", "left").join(one(named(lanes), "interrow_area_m2"), "all", "left").join(n_blocks, "all")
    total = total.select(F.lit(0), F.lit("total"), none, none, none, "row_count", "row_length_m", zero("canopy_area_m2").cast("double"), zero("interrow_area_m2").cast("double"), "block_count")
    both = total.union(out).union(lines)
    both = total.toDF(*out.columns).union(out).union(lines)
    hectares = lambda c: F.round(F.col(c) / 10_000, 4).alias(c.replace("_m2", "_ha"))
    return both.select("rank", "level", "vineyard_id", "row_id", "row_structure", "row_count", F.round("row_length_m", 2).alias("row_length_m"), F.round("canopy_area_m2", 2).alias("canopy_area_m2"), hectares("canopy_area_m2"), F.round("interrow_area_m2", 2).alias("interrow_area_m2"), hectares("interrow_area_m2"), "block_count")


def write_measurements(lines: DataFrame, path: str) -> None:
    """The measurements as one CSV file: total, then each block's line followed by its rows'. Its size is that of a report, not of the data."""
    order = [F.col("level") != "total", "vineyard_id", F.col("rank"), "row_id"]
    lines.orderBy(*order).drop("rank").coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="")


def survey_summary(blocks: DataFrame, rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per block, also the null one, counts and sums of stored properties; every block of the blocks layer has a line, with zeros."""
    kinds = boxes.groupBy("vineyard_id").agg(*[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in ("vineyard", "interrow_area", "waste")], F.sum(F.when(F.col("label") == "vineyard", F.col("area_m2"))).alias("canopy_m2"))
    lines = rows.groupBy(F.nullif("vineyard_id", F.lit("")).alias("vineyard_id")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("row_structure") == "disrupted").alias("n_disrupted"), F.sum("row_length_m").alias("length_m"))
    keys = blocks.select("vineyard_id").union(kinds.select("vineyard_id")).union(lines.select("vineyard_id")).distinct()
    join = lambda a, b: a.join(b.withColumnRenamed("vineyard_id", "_key"), F.col("vineyard_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    out = join(join(keys, lines), kinds)
    return out.select("vineyard_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_disrupted", "n_vineyard", "n_interrow_area", "n_waste", "canopy_m2")], F.round(F.coalesce("length_m", F.lit(0.0)), 2).alias("length_m")).orderBy(F.col("vineyard_id").asc_nulls_last())


def row_groups(rows: DataFrame, shown: list[str]) -> DataFrame:
    """Blocks with rows of the shown structures: counts of the shown rows beside those of all rows of the block."""
    see = F.col("row_structure").isin(shown)
    out = rows.groupBy("vineyard_id").agg(F.count_if(see).alias("n_shown"), F.round(F.sum(F.when(see, F.col("row_length_m"))), 2).alias("shown_m"), F.count("*").alias("n_all"), F.count_if(F.col("row_structure") == "disrupted").alias("n_disrupted"), F.count_if(F.col("row_structure") == "regular").alias("n_regular"))
    return out.where("n_shown > 0")


def interrow_groups(boxes: DataFrame) -> DataFrame:
    """Inter-rows by block ('unassigned' without one): area, mean width and counts of the four covers."""
    counts = [F.count_if(F.col("cover") == c).alias(f"n_{c}") for c in ("bare_soil", "vegetation", "mixed", "unassessable")]
    return boxes.groupBy(F.coalesce("vineyard_id", F.lit("unassigned")).alias("key")).agg(F.count("*").alias("n"), F.sum("area_m2").alias("area_m2"), F.round(F.sum("width_m") / F.greatest(F.lit(1), F.count("*")), 4).alias("mean_width_m"), *counts)


def stops_with_targets(route: DataFrame, targets: DataFrame) -> DataFrame:
    """A route's stops with their targets; a stop's number is its place in the route's array, so gaps stay where a target is unknown."""
    stops = route.select("route_id", F.posexplode(F.arrays_zip("stop_ids", "stop_distances_m")).alias("at", "stop"))
    return stops.join(targets, F.col("stop.stop_ids") == F.col("target_id")).select("route_id", (F.col("at") + 1).alias("stop_order"), "target_id", F.coalesce("stop.stop_distances_m", F.lit(0.0)).alias("distance_m"), "kind")


def legs(stops: DataFrame) -> DataFrame:
    """Stops with the length of the leg to each, and the route's state: how far it was walked, and the first stop not reached."""
    order, whole = Window.partitionBy("route_id").orderBy("stop_order"), Window.partitionBy("route_id")
    walked = F.coalesce(F.max(F.when(F.col("reached"), F.col("distance_m"))).over(whole), F.lit(0.0))
    current = F.min(F.when(~F.col("reached"), F.col("stop_order"))).over(whole)
    return stops.select("route_id", "stop_order", "distance_m", (F.col("distance_m") - F.lag("distance_m", 1, 0.0).over(order)).alias("leg_m"), walked.alias("walked_m"), current.alias("current_stop"))


def manifest(features: DataFrame, part_ids: int = 100_000) -> DataFrame:
    """(label, features, physical_rows, sha256) of each label's features (label, id, row).

    The digest is that of the digests of parts of part_ids ids each, so that no label's ids are gathered in one row.
    """
    joined = lambda x: F.array_join(x, ",")
    parts = features.groupBy("label", F.floor(F.col("id") / part_ids).alias("part")).agg(F.sha2(joined(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))), 256).alias("digest"))
    whole = parts.groupBy("label").agg(F.sha2(joined(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])), 256).alias("sha256"))
    counts = features.groupBy("label").agg(F.count("*").alias("features"), F.count_distinct("row").alias("physical_rows"))
    return counts.join(whole, "label")
