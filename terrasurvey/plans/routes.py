"""Queries of walking networks and routes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import routes
from .inputs import read
from .registry import query


def site_areas(spark, sf_dir):
    """Each nation is a site: lanes 60 m long side by side, joined by two headlands; parts of them are blocked."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("site"), (F.col("s_suppkey") % 20).cast("double").alias("k")).distinct()
    box = lambda x0, y0, x1, y1: F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    lanes = s.select("site", F.lit("interrow_area").alias("label"), box(F.col("k") * 3, F.lit(0.0), F.col("k") * 3 + 2, F.lit(60.0)).alias("ring"))
    heads = s.select("site").distinct().select("site", F.lit("passage").alias("label"), F.explode(F.array(box(F.lit(-1.0), F.lit(-2.0), F.lit(62.0), F.lit(1.0)), box(F.lit(-1.0), F.lit(59.0), F.lit(62.0), F.lit(62.0)))).alias("ring"))
    stones = s.select("site", F.lit("forbidden").alias("label"), box(F.col("k") * 3 + 0.5, F.lit(20.0) + F.col("k"), F.col("k") * 3 + 1.5, F.lit(22.0) + F.col("k")).alias("ring"))
    return lanes.union(heads).union(stones)


def terminals(spark, sf_dir):
    """The start and the targets of each site that don't lie on a stone: 200 at most, as the survey's rules have it."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("site"), (F.col("s_suppkey") + 1).alias("terminal"), (F.col("s_suppkey") % 20).alias("k"), (F.col("s_suppkey") * 7 % 58 + 1).cast("double").alias("y"))
    free = s.where(~F.col("y").between(F.col("k") + 20, F.col("k") + 22)).withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("terminal"))).where("n <= 200")
    targets = free.select("site", "terminal", (F.col("k") * 3 + 1).cast("double").alias("x"), "y")
    return targets.unionByName(s.select("site", F.lit(0).cast("long").alias("terminal"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).distinct())


SQL_TERMINALS = """ends AS (SELECT * EXCLUDE n FROM (SELECT CAST(s_nationkey AS BIGINT) AS site, s_suppkey + 1 AS terminal, s_suppkey % 20 AS k, CAST(s_suppkey * 7 % 58 + 1 AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier WHERE s_suppkey * 7 % 58 + 1 NOT BETWEEN s_suppkey % 20 + 20 AND s_suppkey % 20 + 22) WHERE n <= 200)"""


def cells(spark, sf_dir):
    return routes.walkable_cells(site_areas(spark, sf_dir), ["interrow_area", "passage"], ["forbidden"])


@query("g05_walkable_area", """WITH s AS (SELECT DISTINCT s_nationkey AS site, s_suppkey % 20 AS k FROM supplier) SELECT CAST(site AS BIGINT) AS site, CAST(2 * 63 * 3 + count(*) * (2 * 58 - 2) AS DOUBLE) AS area FROM s GROUP BY 1""")
def g05(spark, sf_dir):
    size = (F.col("x1") - F.col("x0")) * (F.col("b0") - F.col("a0") + F.col("b1") - F.col("a1")) / 2
    return cells(spark, sf_dir).groupBy("site").agg(F.round(F.sum(size), 6).alias("area"))


@query("gr01_network")
def gr01(spark, sf_dir):
    return routes.network(cells(spark, sf_dir)).groupBy("site").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 3).alias("metres"))


@query("gr05_path_lengths")
def gr05(spark, sf_dir):
    return routes.path_lengths(*routes.with_terminals(cells(spark, sf_dir), terminals(spark, sf_dir))).withColumn("metres", F.round("metres", 3))


@query("gr06_tours")
def gr06(spark, sf_dir):
    return routes.tours(routes.path_lengths(*routes.with_terminals(cells(spark, sf_dir), terminals(spark, sf_dir))))


@query("gr09_outside", """SELECT CAST(s_nationkey AS BIGINT) AS site, 60.0::DOUBLE AS length_m, CAST(60 - count(DISTINCT s_suppkey % 20) * 2 AS DOUBLE) AS outside_m FROM supplier GROUP BY 1""")
def gr09(spark, sf_dir):
    a = site_areas(spark, sf_dir).where("label = 'interrow_area'").select("site", "ring")
    line = F.array(F.array(F.lit(0.0), F.lit(30.0)), F.array(F.lit(60.0), F.lit(30.0)))
    return routes.outside(a.select("site").distinct().withColumn("line", line), a).withColumn("outside_m", F.round("outside_m", 6))


@query("gr08_snapped_start")
def gr08(spark, sf_dir):
    nodes = routes.network(cells(spark, sf_dir)).select("site", F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    start = nodes.groupBy("site").agg(F.min(F.struct("x", "y")).alias("m")).select("site", (F.col("m.x") - 1).alias("x"), F.col("m.y").alias("y"))
    return routes.snapped_start(start, nodes)


@query("so06_unique_ids", "SELECT o_orderkey AS id FROM orders UNION ALL SELECT -c_custkey - 1 FROM customer")
def so06(spark, sf_dir):
    return routes.unique_ids(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), read(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("id")))


@query("gr12_plans", f"""WITH {SQL_TERMINALS} SELECT CAST(n_nationkey AS BIGINT) AS site, count(DISTINCT terminal) AS targets, count(DISTINCT terminal) AS visited, true AS closed, true AS in_order, 0.0::DOUBLE AS outside_m
  FROM nation JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = n_nationkey LEFT JOIN ends ON site = n_nationkey GROUP BY 1""")
def gr12(spark, sf_dir):
    """Whole routes: targets attached, toured, expanded, checked against the ground, and stops in the order met, on sites where all targets can be reached."""
    a = site_areas(spark, sf_dir)
    whole = a.where("label <> 'forbidden'").select("site", "ring")
    plans = routes.planned(cells(spark, sf_dir), terminals(spark, sf_dir), whole)
    wanted = terminals(spark, sf_dir).groupBy("site").agg((F.count("*") - 1).alias("targets"))
    closed = F.coalesce(F.element_at("points", 1) == F.element_at("points", -1), F.lit(True))
    rises = F.forall(F.zip_with(F.slice("stops", 1, F.greatest(F.size("stops") - 1, F.lit(0))), F.slice("stops", 2, F.greatest(F.size("stops") - 1, F.lit(0))), lambda x, y: x["distance_m"] <= y["distance_m"]), lambda ok: ok)
    out = wanted.join(plans, "site", "left")
    return out.select("site", "targets", F.coalesce(F.size("stops"), F.lit(0)).cast("long").alias("visited"), closed.alias("closed"), F.coalesce(rises, F.lit(True)).alias("in_order"), F.round(F.coalesce("outside_m", F.lit(0.0)), 6).alias("outside_m"))
