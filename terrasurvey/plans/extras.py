"""Queries of edits and small rules."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import edits, measures
from .inputs import SQL_ANNOTATIONS, SQL_AREAS, SQL_SEGMENTS, SQL_STATUSES, annotations, areas, read, segments, statuses
from .registry import query
from .scalars import SQL_SHAPES, shapes


@query("pr06_box_rings", f"WITH {SQL_AREAS} SELECT interrow_id, 5 AS n, CAST(area_m2 AS DOUBLE) AS area FROM areas")
def pr06(spark, sf_dir):
    ring = g.box_ring(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return areas(spark, sf_dir).withColumn("ring", ring).select("interrow_id", F.size("ring").alias("n"), g.area(F.col("ring")).alias("area"))


@query("pr20_filled_attributes", "SELECT event_id, COALESCE(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, '') AS kind FROM events")
def pr20(spark, sf_dir):
    m = F.create_map(F.lit("kind"), F.when(F.col("event_type") != "view", F.col("event_type")))
    return read(spark, sf_dir, "events").select("event_id", edits.filled(m)["kind"].alias("kind"))


@query("pr21_corridors", f"WITH {SQL_AREAS} SELECT interrow_id, x - CASE WHEN h >= w THEN 0.0::DOUBLE ELSE 10 END AS x0, y - CASE WHEN h >= w THEN 10.0::DOUBLE ELSE 0 END AS y0, x + w + CASE WHEN h >= w THEN 0.0::DOUBLE ELSE 10 END AS x1, y + h + CASE WHEN h >= w THEN 10.0::DOUBLE ELSE 0 END AS y1 FROM areas")
def pr21(spark, sf_dir):
    c = edits.corridor(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return areas(spark, sf_dir).select("interrow_id", c.alias("c")).select("interrow_id", "c.*")


@query("pr22_layers", f"WITH {SQL_ANNOTATIONS} SELECT CASE label WHEN 'vineyard' THEN 'canopy' WHEN 'waste' THEN 'waste' WHEN 'row' THEN 'rows' WHEN 'interrow_area' THEN 'interrows' END AS layer, count(*) AS n FROM annotations GROUP BY 1")
def pr22(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy(edits.layer_of(F.col("label"), strict=False).alias("layer")).agg(F.count("*").alias("n"))


@query("so01_export_set", f"WITH {SQL_ANNOTATIONS}, {SQL_STATUSES} SELECT tile_name AS name FROM annotations UNION SELECT name FROM statuses WHERE verification_status = 'invalid' ORDER BY 1")
def so01(spark, sf_dir):
    invalid = statuses(spark, sf_dir).where("verification_status = 'invalid'").select("name")
    return annotations(spark, sf_dir).select(F.col("tile_name").alias("name")).union(invalid).distinct().orderBy("name")


@query("so05_block_ids", f"WITH {SQL_AREAS}, {SQL_SEGMENTS} SELECT vineyard_id FROM areas WHERE label = 'vineyard' AND vineyard_id <> '' UNION SELECT vineyard_id FROM segments WHERE vineyard_id <> ''")
def so05(spark, sf_dir):
    a = areas(spark, sf_dir).where("label = 'vineyard'").select("vineyard_id")
    return a.union(segments(spark, sf_dir).select("vineyard_id")).where("vineyard_id != ''").distinct()


@query("so07_orphans", "SELECT DISTINCT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def so07(spark, sf_dir):
    seeded = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("part")).distinct()
    return edits.orphans(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")), seeded, "part")


@query("j03_block_measures", f"""WITH {SQL_AREAS}, c AS (SELECT vineyard_id AS v, CAST(sum(area_m2) AS BIGINT) AS canopy FROM areas WHERE label = 'vineyard' AND vineyard_id IS NOT NULL GROUP BY 1),
  r AS (SELECT 'V' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS v, count(*) AS n_rows FROM orders GROUP BY 1), l AS (SELECT vineyard_id AS v, CAST(sum(area_m2) AS BIGINT) AS lanes FROM areas WHERE label = 'interrow_area' AND vineyard_id IS NOT NULL GROUP BY 1)
  SELECT COALESCE(c.v, r.v) AS vineyard_id, canopy, n_rows, lanes FROM c FULL JOIN r ON c.v = r.v LEFT JOIN l ON l.v = COALESCE(c.v, r.v)""")
def j03(spark, sf_dir):
    a = areas(spark, sf_dir).where("vineyard_id is not null")
    of = lambda label, name: a.where(F.col("label") == label).groupBy("vineyard_id").agg(F.sum("area_m2").alias(name))
    rows = read(spark, sf_dir, "orders").groupBy(F.format_string("V%02d", (F.col("o_custkey") % 40).cast("int")).alias("vineyard_id")).agg(F.count("*").alias("n_rows"))
    return edits.block_measures(of("vineyard", "canopy"), rows, of("interrow_area", "lanes"), "vineyard_id")


@query("j17_headlands", "SELECT c_nationkey AS block, count(*) AS n_axes FROM customer GROUP BY 1")
def j17(spark, sf_dir):
    return edits.headlands(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block")), "block")


@query("j18_targets_with_canopy", f"""WITH {SQL_AREAS}, c AS (SELECT vineyard_id AS v, CAST(sum(area_m2) AS BIGINT) AS canopy FROM areas WHERE label = 'vineyard' AND vineyard_id IS NOT NULL GROUP BY 1), t AS (SELECT CAST(sum(canopy) AS BIGINT) AS whole FROM c)
  SELECT o_orderkey, COALESCE(canopy, whole) AS canopy FROM orders LEFT JOIN c ON c.v = 'V' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0'), t""")
def j18(spark, sf_dir):
    canopy = areas(spark, sf_dir).where("label = 'vineyard' and vineyard_id is not null").groupBy("vineyard_id").agg(F.sum("area_m2").alias("canopy"))
    gaps = read(spark, sf_dir, "orders").select("o_orderkey", F.format_string("V%02d", (F.col("o_custkey") % 60).cast("int")).alias("vineyard_id"))
    return edits.targets_with_canopy(gaps, canopy, "vineyard_id", "canopy").select("o_orderkey", "canopy")


@query("p05_valid_rings", f"WITH {SQL_SHAPES} SELECT id, abs(w * h - 6) > 0 AS valid FROM shapes")
def p05(spark, sf_dir):
    return shapes(spark, sf_dir).select("id", edits.valid_ring(F.col("ring")).alias("valid"))


@query("p14_size_cut_offs", f"WITH {SQL_AREAS} SELECT label, count(*) AS n FROM areas WHERE area_m2 >= CASE label WHEN 'vineyard' THEN 15 WHEN 'interrow_area' THEN 20 ELSE 2 END GROUP BY 1")
def p14(spark, sf_dir):
    least = F.when(F.col("label") == "vineyard", 15).when(F.col("label") == "interrow_area", 20).otherwise(2)
    return areas(spark, sf_dir).where(F.col("area_m2") >= least).groupBy("label").agg(F.count("*").alias("n"))


@query("g10_joined_strips", f"""WITH {SQL_AREAS} SELECT vineyard_id, CAST(greatest(min(x), 0) AS DOUBLE) AS x0, CAST(greatest(min(y), 0) AS DOUBLE) AS y0, CAST(least(max(x + w), 64.0::DOUBLE) AS DOUBLE) AS x1, CAST(least(max(y + h), 56.0::DOUBLE) AS DOUBLE) AS y1, arg_min(cover, interrow_id) AS cover
  FROM areas WHERE label = 'interrow_area' GROUP BY 1""")
def g10(spark, sf_dir):
    return edits.joined_strips(areas(spark, sf_dir).where("label = 'interrow_area'"), ["vineyard_id"], 64.0, 56.0).drop("ring")


@query("g11_erased_lines", """WITH t AS (SELECT p_partkey AS id, CAST(p_partkey % 30 AS DOUBLE) AS a, CAST(p_partkey % 30 + p_size AS DOUBLE) AS b FROM part)
  SELECT id, a AS first, least(b, 21) AS last FROM t WHERE least(b, 21) - a >= 2 UNION ALL SELECT id, greatest(a, 29), b FROM t WHERE b - greatest(a, 29) >= 2""")
def g11(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30).cast("double").alias("first"), (F.col("p_partkey") % 30 + F.col("p_size")).cast("double").alias("last"))
    return edits.erased(t, "id", "first", "last", 25.0, 3.0)


@query("g13_snapped_rings", f"WITH {SQL_SHAPES} SELECT id, 5 AS n, round(x + 0.004::DOUBLE, 2) AS x0 FROM shapes")
def g13(spark, sf_dir):
    moved = F.transform("ring", lambda p: F.struct((p["x"] + 0.004).alias("x"), p["y"].alias("y")))
    return shapes(spark, sf_dir).withColumn("s", edits.snapped(moved)).select("id", F.size("s").alias("n"), F.round(F.col("s")[0]["x"], 2).alias("x0"))


@query("w12_pieces_outside", """SELECT l_orderkey, l_linenumber, round(greatest(0, least(b, 100) - a) + greatest(0, b - greatest(a, 300)), 6) AS outside_m FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 400 AS DOUBLE) AS a, CAST(l_partkey % 400 AS DOUBLE) + l_quantity AS b FROM lineitem)
  WHERE greatest(0, least(b, 100) - a) + greatest(0, b - greatest(a, 300)) > 1e-9""")
def w12(spark, sf_dir):
    a = (F.col("l_partkey") % 400).cast("double")
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), (a + F.col("l_quantity")).alias("b"))
    zero = F.lit(0.0)
    out = F.greatest(zero, F.least(F.col("b"), F.lit(100.0)) - F.col("a")) + F.greatest(zero, F.col("b") - F.greatest(F.col("a"), F.lit(300.0)))
    return t.withColumn("outside_m", out).where("outside_m > 1e-9").select("l_orderkey", "l_linenumber", F.round("outside_m", 6).alias("outside_m"))


@query("f19_styles", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 1.0::DOUBLE WHEN p_size < 20 THEN 1 + (p_size - 10) * 0.2::DOUBLE WHEN p_size < 40 THEN 3 + (p_size - 20) * 0.05::DOUBLE ELSE 4 END AS line_width FROM part")
def f19(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", edits.interpolated(F.col("p_size"), [(10, 1), (20, 3), (40, 4)]).alias("line_width"))


@query("u01_gap_function", """WITH p AS (SELECT l_suppkey AS row, CAST(l_partkey % 400 AS DOUBLE) AS a, CAST(l_partkey % 400 AS DOUBLE) + l_quantity / 100 AS b FROM lineitem),
  s AS (SELECT row, a, max(b) OVER (PARTITION BY row ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM p) SELECT row, e AS gap_start, a AS gap_end FROM s WHERE a - e >= 1.5""")
def u01(spark, sf_dir):
    edits.register(spark)
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 400).cast("double").alias("a"), ((F.col("l_partkey") % 400).cast("double") + F.col("l_quantity") / 100).alias("b"))
    # stretches that touch are merged first, so a row's arrays stay short
    p = measures.covered(p, ["row"]).groupBy("row").agg(F.collect_list("first").alias("a"), F.collect_list("last").alias("b"))
    p.createOrReplaceTempView("_survey_rows")
    return spark.sql("SELECT row, gap_start, gap_end FROM _survey_rows, LATERAL survey_gaps(a, b, 1.5D)")


@query("pr07_decoded_rows", """SELECT event_id, event_type AS kind, CAST(value AS DOUBLE) AS x, 2 AS n, event_type IS NULL AS bare FROM (SELECT event_id, event_type, user_id % 100 AS value FROM events)""")
def pr07(spark, sf_dir):
    x = (F.col("user_id") % 100).cast("double")
    stored = read(spark, sf_dir, "events").select("event_id", F.to_json(F.array(F.array(x, x + 1), F.array(x, x + 2))).alias("points"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("attributes"))
    t = edits.decoded(stored)
    return t.select("event_id", F.try_element_at("attributes", F.lit("kind")).alias("kind"), F.col("points")[0]["x"].alias("x"), F.size("points").alias("n"), (F.size("attributes") == 0).alias("bare"))


@query("f14_number_formats", """SELECT p_partkey, format('{:,}', CAST(p_partkey * 7919 AS BIGINT)) || ' m²' AS area, format('{:,}', CAST(p_partkey * 31 AS BIGINT)) || ' m' AS metres,
  format('{:.1f}%', round((p_partkey % 801) / 800.0::DOUBLE * 100, 1)) AS percent, CASE WHEN p_partkey % 5 = 1 THEN '1 row' ELSE CAST(p_partkey % 5 AS VARCHAR) || ' rows' END AS rows FROM part WHERE p_partkey % 8 <> 0""")
def f14(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").where("p_partkey % 8 != 0")
    return p.select("p_partkey", tx.square_metres(k * 7919).alias("area"), tx.metres(k * 31).alias("metres"), tx.percent((k % 801) / 800).alias("percent"), tx.quantity(k % 5, "row", "rows").alias("rows"))
