"""What a reader of a survey has chosen: rows of the label store by key, visible groups, places of a selection, extents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def labels_of(annotations: DataFrame, tile: str) -> DataFrame:
    """The labels of one tile, by id. The filter reaches the scan."""
    return annotations.where(F.col("tile_name") == tile).orderBy("id")


def label_by_id(annotations: DataFrame, number: int) -> DataFrame:
    """The label with an id; no row if there is none."""
    return annotations.where(F.col("id") == number)


def status_of(statuses: DataFrame, tile: str) -> DataFrame:
    """A tile's row of status; no row if it has none."""
    return statuses.where(F.col("name") == tile)


def visible_groups(rows: DataFrame, group: str, kind: str, shown: list[str]) -> DataFrame:
    """(group, n_all, n_shown, and the columns of rows): the rows of the kinds shown, with how many their group has of all and of these; groups with none shown go.

    Counts are made before rows are joined to them, so a large group is shared out.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n_all"), F.count_if(F.col(kind).isin(shown)).alias("n_shown"))
    return rows.where(F.col(kind).isin(shown)).join(counts, group)


def located(selections: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """(selection columns, block, points): where selections (kind, id) are. layers: kind -> (id, block, points).

    A block, a row or a finding is looked up in the layer of its kind; null points where there is none.
    """
    known = None
    for kind, layer in layers.items():
        part = layer.select(F.lit(kind).alias("kind"), F.col("id"), "block", "points")
        known = part if known is None else known.unionByName(part)
    return selections.join(known, ["kind", "id"], "left")


def extent(points: Column) -> Column:
    """The bounds of an array of points as (x0, y0, x1, y1); null without any."""
    return F.when(F.size(F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>"))) > 0, g.bounds(points))


def normal_email(address: Column) -> Column:
    """An address without blanks around it, in lower case."""
    return F.lower(F.regexp_replace(address, r"^\s+|\s+$", ""))
