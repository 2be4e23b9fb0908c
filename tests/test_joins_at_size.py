"""Joins whose work is more than their tables' bytes tell: they are dealt by cells, and nothing is broadcast."""

from pyspark.sql import functions as F

from terrasurvey.operators import lines, spatial
from terrasurvey.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_are_dealt_by_cells(spark):
    boxes = spark.range(20).select("id", *[(F.col("id") + d).cast("double").alias(c) for c, d in (("x0", 0), ("y0", 0), ("x1", 2), ("y1", 2))])
    text = plan(spatial.box_join(boxes, boxes, 4.0))
    assert "SortMergeJoin" in text and "Broadcast" not in text and "REPARTITION_BY_NUM" in text


def test_clipped_boxes_build_no_rings(spark):
    text = plan(QUERIES["j11_clipped_parcels"](spark, SF))
    assert "Broadcast" not in text and "zip_with" not in text


def test_erased_points_are_not_broadcast(spark):
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    discs = spark.createDataFrame([(3.0, 0.0)], "x double, y double")
    left = lines.brushed(spark.range(3).select("id", F.array(p(0, 0), p(9, 0)).alias("points")), discs, "id", 1.0)
    assert "Broadcast" not in plan(left)
    assert left.count() == 6
