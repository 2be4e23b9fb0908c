"""Queries of selections, groups shown, extents, and windows that slide over tiles."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import raster, selection
from .inputs import SQL_ANNOTATIONS, SQL_SEGMENTS, SQL_STATUSES, annotations, read, segments, statuses
from .ordered import SQL_PATH, path
from .registry import query


@query("sc09_labels_of_tile", f"WITH {SQL_ANNOTATIONS} SELECT id, label, shape_type, n_points FROM annotations WHERE tile_name = 'tile_r000_c007'")
def sc09(spark, sf_dir):
    return selection.labels_of(annotations(spark, sf_dir), "tile_r000_c007").select("id", "label", "shape_type", "n_points")


@query("sc09_status_of_tile", f"WITH {SQL_STATUSES} SELECT * FROM statuses WHERE name = 'tile_r000_c007'")
def sc09_status(spark, sf_dir):
    return selection.status_of(statuses(spark, sf_dir), "tile_r000_c007")


@query("p13_visible_groups", f"""WITH {SQL_SEGMENTS}, c AS (SELECT vineyard_id, count(*) AS n_all, count(*) FILTER (row_structure IN ('regular', 'disrupted')) AS n_shown FROM segments GROUP BY 1)
  SELECT vineyard_id, row_structure, n_all, n_shown, count(*) AS n FROM segments JOIN c USING (vineyard_id) WHERE row_structure IN ('regular', 'disrupted') GROUP BY ALL""")
def p13(spark, sf_dir):
    rows = selection.visible_groups(segments(spark, sf_dir), "vineyard_id", "row_structure", ["regular", "disrupted"])
    return rows.groupBy("vineyard_id", "row_structure", "n_all", "n_shown").agg(F.count("*").alias("n"))


@query("f11_emails", r"SELECT c_custkey, 'user' || c_custkey || '@site.org' AS email FROM customer")
def f11(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select("c_custkey", selection.normal_email(F.concat(F.lit("\t User"), k, F.lit("@Site.ORG \n"))).alias("email"))


@query("f17_extents", f"WITH {SQL_PATH} SELECT route_id, CASE WHEN route_id % 7 > 0 THEN min(x) END AS x0, CASE WHEN route_id % 7 > 0 THEN min(y) END AS y0, CASE WHEN route_id % 7 > 0 THEN max(x) END AS x1, CASE WHEN route_id % 7 > 0 THEN max(y) END AS y1 FROM path GROUP BY 1")
def f17(spark, sf_dir):
    """The extents of routes; every seventh has no points."""
    routes = path(spark, sf_dir).groupBy("route_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    points = F.when(F.col("route_id") % 7 > 0, F.col("p")).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return routes.select("route_id", selection.extent(points).alias("b")).select("route_id", "b.*")


@query("f18_located_selections", """WITH s AS (SELECT o_orderkey, ['row', 'waste', 'block'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS kind, o_orderkey % 40 AS id FROM orders),
  k AS (SELECT 'block' AS kind, n_nationkey AS id, n_nationkey AS block, n_nationkey * 2.0::DOUBLE AS x FROM nation UNION ALL SELECT 'row', s_suppkey, s_nationkey, s_suppkey * 3.0::DOUBLE FROM supplier UNION ALL SELECT 'waste', p_partkey, p_partkey % 25, p_partkey * 5.0::DOUBLE FROM part)
  SELECT o_orderkey, s.kind, s.id, block, x FROM s LEFT JOIN k ON s.kind = k.kind AND s.id = k.id""")
def f18(spark, sf_dir):
    at = lambda x: F.array(F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("points")
    layers = {
        "block": read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("block"), at(F.col("n_nationkey") * 2)),
        "row": read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("block"), at(F.col("s_suppkey") * 3)),
        "waste": read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") % 25).alias("block"), at(F.col("p_partkey") * 5)),
    }
    kind = F.element_at(F.array(*map(F.lit, ("row", "waste", "block"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    chosen = read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), (F.col("o_orderkey") % 40).alias("id"))
    return selection.located(chosen, layers).select("o_orderkey", "kind", "id", "block", F.col("points")[0]["x"].alias("x"))


@query("i08_sliding_windows", """WITH v AS (SELECT l_suppkey % 10 AS tile, l_partkey % 40 AS px, l_orderkey % 30 AS py, avg(l_discount) AS v FROM lineitem GROUP BY ALL),
  w AS (SELECT v.*, px - sx AS i, py - sy AS j FROM v, (SELECT unnest([0, 12, 24]) AS sx), (SELECT unnest([0, 7, 14]) AS sy) WHERE px - sx BETWEEN 0 AND 15 AND py - sy BETWEEN 0 AND 15),
  r AS (SELECT *, least(1, least(i + 1, 16 - i) / 4.0::DOUBLE) * least(1, least(j + 1, 16 - j) / 4.0::DOUBLE) AS k FROM w)
  SELECT tile, px, py, round(sum(k * (v + (i + 15) / 3.0::DOUBLE)) / sum(k), 6) AS score FROM r GROUP BY ALL""")
def i08_sliding(spark, sf_dir):
    """Scores that depend on the place in the window, so that mirrored means and weights show."""
    t = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("tile"), (F.col("l_partkey") % 40).alias("px"), (F.col("l_orderkey") % 30).alias("py")).agg(F.avg("l_discount").alias("value"))
    scored = raster.slid(t, ["tile"], 40, 30, 16, 4, lambda image: image + np.arange(image.shape[1])[None, :])
    return scored.join(t.select("tile", "px", "py"), ["tile", "px", "py"]).select("tile", "px", "py", F.round("score", 6).alias("score"))
