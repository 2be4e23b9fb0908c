"""Queries of pixel tables and regions."""

from pyspark.sql import functions as F

from ..operators import raster, segments
from .inputs import read
from .registry import query

SQL_PIXELS = """pixels AS (SELECT label AS tile, vec_id, CAST(floor(256 * CAST(embedding[1] AS DOUBLE)) AS BIGINT) % 256 AS r0, CAST(floor(256 * CAST(embedding[2] AS DOUBLE)) AS BIGINT) % 256 AS g0, CAST(floor(256 * CAST(embedding[3] AS DOUBLE)) AS BIGINT) % 256 AS b0 FROM embeddings),
  rgb AS (SELECT tile, vec_id, abs(r0) AS r, abs(g0) AS g, abs(b0) AS b FROM pixels)"""


def rgb(spark, sf_dir):
    level = lambda i: F.abs(F.floor(256 * F.col("embedding")[i].cast("double")) % 256)
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("tile"), "vec_id", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


@query("i01_vegetation_index", f"WITH {SQL_PIXELS} SELECT tile, vec_id, round(CASE WHEN r + g + b > 0 THEN (2 * g - r - b) / CAST(r + g + b AS DOUBLE) END, 9) AS exg FROM rgb")
def i01(spark, sf_dir):
    return rgb(spark, sf_dir).select("tile", "vec_id", F.round(raster.vegetation_index(F.col("r"), F.col("g"), F.col("b")), 9).alias("exg"))


@query("a23_ground_cover", f"""WITH {SQL_PIXELS}, e AS (SELECT tile, CASE WHEN r + g + b > 0 THEN (2 * g - r - b) / CAST(r + g + b AS DOUBLE) END AS x FROM rgb), s AS (SELECT tile, avg(CASE WHEN x IS NOT NULL THEN CAST(x > 0.05::DOUBLE AS INTEGER) END) AS share FROM e GROUP BY 1)
  SELECT tile, CASE WHEN share IS NULL THEN 'unassessable' WHEN share < 0.2::DOUBLE THEN 'bare_soil' WHEN share >= 0.6::DOUBLE THEN 'vegetation' ELSE 'mixed' END AS cover FROM s""")
def a23(spark, sf_dir):
    x = raster.vegetation_index(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf_dir).withColumn("x", x).groupBy("tile").agg(raster.cover_class(F.col("x")).alias("cover"))


@query("a24_seed_vegetation", f"WITH {SQL_PIXELS} SELECT tile, avg(CASE WHEN 2 * g > r + b THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS green FROM rgb GROUP BY 1")
def a24(spark, sf_dir):
    return rgb(spark, sf_dir).groupBy("tile").agg((F.avg((2 * F.col("g") > F.col("r") + F.col("b")).cast("double")) > 0.5).alias("green"))


@query("a19_otsu", f"""WITH {SQL_PIXELS}, ends AS (SELECT tile, min(g) AS lo, max(g) AS hi FROM rgb GROUP BY 1),
  c AS (SELECT tile, lo, hi, least(CAST(floor((g - lo) / CAST(hi - lo AS DOUBLE) * 256) AS INTEGER), 255) AS bin, CAST(count(*) AS DOUBLE) AS n FROM rgb JOIN ends USING (tile) WHERE hi > lo GROUP BY 1, 2, 3, 4),
  s AS (SELECT *, sum(n) OVER w AS w0, sum(n) OVER (PARTITION BY tile) AS w, sum(n * (bin + 0.5::DOUBLE)) OVER w AS m0, sum(n * (bin + 0.5::DOUBLE)) OVER (PARTITION BY tile) AS m FROM c WINDOW w AS (PARTITION BY tile ORDER BY bin)),
  v AS (SELECT *, round(CASE WHEN w > w0 THEN w0 * (w - w0) * pow(m0 / w0 - (m - m0) / (w - w0), 2) ELSE 0 END, 6) AS v FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY v DESC, bin) AS k FROM v)
  SELECT tile, lo + (bin + 0.5::DOUBLE) / 256 * (hi - lo) AS threshold FROM k WHERE k = 1 UNION ALL SELECT tile, CAST(lo AS DOUBLE) FROM ends WHERE hi = lo""")
def a19(spark, sf_dir):
    return raster.otsu(rgb(spark, sf_dir).select("tile", F.col("g").cast("double").alias("g")), "tile", "g")


@query("a20_percentile_stretch", f"WITH {SQL_PIXELS} SELECT tile, quantile_cont(CAST(g AS DOUBLE), 0.02::DOUBLE) AS low, quantile_cont(CAST(g AS DOUBLE), 0.98::DOUBLE) AS high FROM rgb GROUP BY 1")
def a20(spark, sf_dir):
    p = F.percentile(F.col("g").cast("double"), F.array(F.lit(0.02), F.lit(0.98)))
    return rgb(spark, sf_dir).groupBy("tile").agg(p.alias("p")).select("tile", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


@query("a26_region_scores", "SELECT label AS region, round(avg(CAST(embedding[1] AS DOUBLE)), 4) AS score FROM embeddings GROUP BY 1")
def a26(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("region")).agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 4).alias("score"))


@query("i08_blended_windows", "SELECT l_partkey AS place, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS score FROM lineitem GROUP BY 1")
def i08(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("place"), "l_discount", "l_quantity")
    return raster.blended(t, ["place"], "l_discount", "l_quantity").withColumn("score", F.round("score", 9))


@query("i02_clip_windows", """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS x0, CAST(l_suppkey AS DOUBLE) AS y0, CAST(l_partkey AS DOUBLE) + CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity * 20 END AS x1, CAST(l_suppkey AS DOUBLE) AS y1, l_returnflag = 'A' AS point FROM lineitem)
  SELECT l_orderkey, l_linenumber, x0 - m AS x0, x1 + m AS x1 FROM (SELECT *, CASE WHEN point THEN 140.0::DOUBLE ELSE least(300.0::DOUBLE, greatest(80.0::DOUBLE, 80 + 0.5::DOUBLE * greatest(x1 - x0, y1 - y0))) END AS m FROM d)""")
def i02(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    point = F.col("l_returnflag") == "A"
    x0, y0 = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double")
    w = segments.clip_window(x0, y0, x0 + F.when(point, F.lit(0.0)).otherwise(F.col("l_quantity") * 20), y0, point)
    return t.select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", "w.x0", "w.x1")


SQL_REGIONS = """regions AS (SELECT p_partkey AS id, CAST(p_size * 100 AS DOUBLE) AS area, CASE WHEN p_size = 1 THEN CAST('inf' AS DOUBLE) ELSE p_partkey % 13 / 1.5::DOUBLE END AS aspect, p_partkey % 10 / 10.0::DOUBLE AS green,
  CASE WHEN p_type = 'PROMO' THEN 'waste' WHEN p_type = 'SMALL' THEN NULL ELSE 'auto' END AS hint, p_type = 'LARGE' AS by_road FROM part),
  classed AS (SELECT id, CASE WHEN aspect >= 6 AND aspect < CAST('inf' AS DOUBLE) AND green >= 0.5::DOUBLE THEN 'row' WHEN (aspect >= 6 AND aspect < CAST('inf' AS DOUBLE)) OR by_road THEN 'interrow_area' WHEN hint = 'waste' THEN 'waste' WHEN green >= 0.5::DOUBLE THEN 'vineyard' ELSE 'interrow_area' END AS label,
  round(CASE WHEN aspect >= 6 AND aspect < CAST('inf' AS DOUBLE) THEN least(0.95::DOUBLE, 0.5::DOUBLE + aspect / 40) WHEN hint = 'waste' THEN 0.6::DOUBLE ELSE least(0.9::DOUBLE, 0.4::DOUBLE + area / 10000) END, 4) AS confidence FROM regions)"""


def regions(spark, sf_dir):
    t = read(spark, sf_dir, "part")
    aspect = F.when(F.col("p_size") == 1, F.lit(float("inf"))).otherwise(F.col("p_partkey") % 13 / 1.5)
    hint = F.when(F.col("p_type") == "PROMO", "waste").when(F.col("p_type") != "SMALL", "auto")
    c = segments.region_class((F.col("p_size") * 100).cast("double"), aspect, F.col("p_partkey") % 10 / 10, hint, F.col("p_type") == "LARGE")
    return t.select(F.col("p_partkey").alias("id"), c.alias("c")).select("id", "c.*")


@query("i03_region_classes", f"WITH {SQL_REGIONS} SELECT * FROM classed")
def i03(spark, sf_dir):
    return regions(spark, sf_dir)


@query("i04_parcel_restriction", f"WITH {SQL_REGIONS}, hit AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45) SELECT c.id, label, CASE WHEN h.id IS NOT NULL THEN confidence ELSE round(confidence / 2, 4) END AS confidence, CASE WHEN h.id IS NOT NULL THEN '' ELSE 'outside parcel' END AS reason FROM classed c LEFT JOIN hit h USING (id)")
def i04(spark, sf_dir):
    inside = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return segments.within_parcel(regions(spark, sf_dir), inside, "id")


@query("i05_instances")
def i05(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("tile"), (F.col("l_partkey") % 48).cast("int").alias("row"), (F.col("l_orderkey") % 48).cast("int").alias("col")).agg((F.avg("l_quantity") / 50).alias("vine"), (F.avg("l_discount") * 10).alias("edge"))
    return segments.split_instances(t, 48)


SQL_SCORED = """counts_{0} AS (SELECT block, theta, floor(round((y * cos(radians(theta)) - x * sin(radians(theta))) / 0.25, 9)) AS bin, sum(n) AS n FROM {0} GROUP BY ALL),
  scores_{0} AS (SELECT block, theta, round(CAST(sum(n * n) AS DOUBLE) / pow(CAST(sum(n) AS DOUBLE), 2) * (max(bin) - min(bin) + 1), 9) AS score FROM counts_{0} GROUP BY ALL),
  best_{0} AS (SELECT block, first(theta ORDER BY score DESC, theta) AS theta FROM scores_{0} GROUP BY block)"""


@query("g17_row_direction", f"""WITH t AS (SELECT c_nationkey AS block, CAST(c_custkey % 97 AS DOUBLE) AS s, 2.5::DOUBLE * (c_custkey % 7) AS r, radians(c_nationkey * 7.0::DOUBLE) AS a FROM customer),
  cells AS (SELECT block, floor((s * cos(a) - r * sin(a)) / 0.0625::DOUBLE + 0.5) * 0.0625::DOUBLE AS x, floor((s * sin(a) + r * cos(a)) / 0.0625::DOUBLE + 0.5) * 0.0625::DOUBLE AS y, count(*) AS n FROM t GROUP BY ALL),
  coarse AS (SELECT *, CAST(unnest(range(180)) AS DOUBLE) AS theta FROM cells), {SQL_SCORED.format("coarse")},
  fine AS (SELECT c.*, theta + d AS theta FROM cells c JOIN best_coarse USING (block), (SELECT unnest(range(-10, 11)) / 10.0::DOUBLE AS d)), {SQL_SCORED.format("fine")}
  SELECT block, theta FROM best_fine""")
def g17(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), (F.col("c_custkey") % 97).cast("double").alias("s"), (F.col("c_custkey") % 7).cast("double").alias("r"))
    a = F.radians(F.col("block") * 7.0)
    return segments.row_direction(t.select("block", (F.col("s") * F.cos(a) - 2.5 * F.col("r") * F.sin(a)).alias("x"), (F.col("s") * F.sin(a) + 2.5 * F.col("r") * F.cos(a)).alias("y")), ["block"])


@query("g16_sampled_points", """WITH b AS (SELECT p_partkey AS id, CAST(p_partkey % 50 AS DOUBLE) AS x0, CAST(p_partkey % 20 AS DOUBLE) AS y0, CAST(p_partkey % 50 + p_size % 9 + 1 AS DOUBLE) AS x1, CAST(p_partkey % 20 + 3 AS DOUBLE) AS y1 FROM part)
  SELECT id, CAST((x1 - x0) * 2 * 6 AS BIGINT) AS n FROM b""")
def g16(spark, sf_dir):
    x, y = (F.col("p_partkey") % 50).cast("double"), (F.col("p_partkey") % 20).cast("double")
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") % 9 + 1).alias("x1"), (y + 3).alias("y1"))
    return segments.sampled_grid(b, 0.5).groupBy("id").agg(F.count("*").alias("n"))
