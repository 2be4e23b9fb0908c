"""Queries of scalar functions: geometry, text, dates and JSON."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from .inputs import SQL_AREAS, SQL_TILES, areas, read, tiles
from .registry import query

SQL_SHAPES = """shapes AS (SELECT p_partkey AS id, CAST(p_partkey % 90 AS DOUBLE) AS x, CAST(p_partkey % 70 AS DOUBLE) AS y, CAST(p_size + 1 AS DOUBLE) AS w, CAST(p_partkey % 9 + 1 AS DOUBLE) AS h FROM part)"""


def shapes(spark, sf_dir):
    """(id, x, y, w, h, ring, line): a slanted quadrilateral and a line of three points for each part."""
    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90).cast("double").alias("x"), (F.col("p_partkey") % 70).cast("double").alias("y"), (F.col("p_size") + 1).cast("double").alias("w"), (F.col("p_partkey") % 9 + 1).cast("double").alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    ring = F.array(g.point(x, y), g.point(x + w, y + 2), g.point(x + w + 3, y + h + 2), g.point(x + 3, y + h), g.point(x, y))
    return t.withColumn("ring", ring).withColumn("line", F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h)))


@query("g02_area_and_length", f"WITH {SQL_SHAPES} SELECT id, round(abs(w * h - 6), 6) AS area, w + h AS line_length, round(2 * sqrt(w * w + 4) + 2 * sqrt(9 + h * h), 6) AS perimeter FROM shapes")
def g02(spark, sf_dir):
    s = shapes(spark, sf_dir)
    return s.select("id", F.round(g.area(F.col("ring")), 6).alias("area"), g.length(F.col("line")).alias("line_length"), F.round(g.length(F.col("ring")), 6).alias("perimeter"))


@query("g03_segment_distance", f"""WITH {SQL_SHAPES}, t AS (SELECT *, CASE WHEN w * w + h * h > 0 THEN greatest(0, least(1, ((20 - x) * w + (30 - y) * h) / (w * w + h * h))) ELSE 0 END AS t FROM shapes)
  SELECT id, round(sqrt(pow(20 - (x + t * w), 2) + pow(30 - (y + t * h), 2)), 6) AS distance FROM t""")
def g03(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return shapes(spark, sf_dir).select("id", F.round(g.segment_distance(F.lit(20.0), F.lit(30.0), x, y, x + w, y + h), 6).alias("distance"))


@query("p06_point_in_ring", f"WITH {SQL_SHAPES} SELECT id, 50.5::DOUBLE >= x AND 50.5::DOUBLE < x + w AND 30.5::DOUBLE >= y AND 30.5::DOUBLE < y + h AS inside FROM shapes")
def p06(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return shapes(spark, sf_dir).select("id", g.contains(g.box_ring(x, y, w, h), F.lit(50.5), F.lit(30.5)).alias("inside"))


@query("g08_half_plane_clip", f"WITH {SQL_SHAPES} SELECT id, greatest(0, least(x + w, 50) - x) * greatest(0, h) AS below, greatest(0, x + w - greatest(x, 50)) * h AS above FROM shapes")
def g08(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    s = shapes(spark, sf_dir).withColumn("box", g.open_ring(g.box_ring(x, y, w, h)))
    part = lambda below: F.coalesce(g.area(g.close_ring(g.clip_box(F.col("box"), "x", F.lit(50.0), below))), F.lit(0.0))
    return s.select("id", part(True).alias("below"), part(False).alias("above"))


@query("g09_cut_line", f"WITH {SQL_SHAPES} SELECT id, w AS head_m, h AS tail_m FROM shapes")
def g09(spark, sf_dir):
    s = shapes(spark, sf_dir).withColumn("cut", g.cut_line(F.col("line"), F.lit(2)))
    return s.select("id", g.length(F.col("cut.head")).alias("head_m"), g.length(F.col("cut.tail")).alias("tail_m"))


@query("pr01_pixel_to_world", f"WITH {SQL_SHAPES} SELECT id, 629000 + 0.025::DOUBLE * x AS world_x, 5220000 - 0.025::DOUBLE * y AS world_y, TRUE AS back FROM shapes")
def pr01(spark, sf_dir):
    transform = (0.025, 0.0, 629000.0, 0.0, -0.025, 5220000.0)
    s = shapes(spark, sf_dir).withColumn("world", g.affine(F.col("ring"), *map(F.lit, transform)))
    again = g.inverse_affine(F.col("world"), *map(F.lit, transform))
    near = F.forall(F.zip_with(again, F.col("ring"), lambda a, b: F.struct((F.abs(a["x"] - b["x"]) < 1e-6).alias("x"), (F.abs(a["y"] - b["y"]) < 1e-6).alias("y"))), lambda p: p["x"] & p["y"])
    return s.select("id", F.col("world")[0]["x"].alias("world_x"), F.col("world")[0]["y"].alias("world_y"), near.alias("back"))


@query("pr03_parts", f"WITH {SQL_SHAPES} SELECT id, CAST(k AS INTEGER) AS part, x + k AS first_x FROM shapes, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR id % 2 = 0")
def pr03(spark, sf_dir):
    s = shapes(spark, sf_dir).withColumn("parts", F.when(F.col("id") % 2 == 0, F.array("ring", F.transform("ring", lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"))))).otherwise(F.array("ring")))
    return s.select("id", F.posexplode("parts").alias("part", "ring")).select("id", "part", F.col("ring")[0]["x"].alias("first_x"))


@query("pr05_attributes", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, len(list_filter([CASE WHEN event_id % 2 = 0 THEN 'x' END, props->>'$.k'], lambda v: v IS NOT NULL)) AS n FROM events""")
def pr05(spark, sf_dir):
    value = F.get_json_object("props", "$.k")
    kept = F.map_filter(F.create_map(F.lit("score"), F.when(F.col("event_id") % 2 == 0, "x"), F.lit("k"), value), lambda k, v: v.isNotNull())
    return read(spark, sf_dir, "events").select("event_id", value.cast("long").alias("k"), F.size(kept).cast("long").alias("n"))


@query("f16_json_default", "SELECT event_id, COALESCE(CAST(props->>'$.missing' AS BIGINT), -1) AS missing, CAST(props->>'$.k' AS BIGINT) % 7 AS k FROM events")
def f16(spark, sf_dir):
    p = F.from_json("props", "k long, missing long")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(p["missing"], F.lit(-1)).alias("missing"), (p["k"] % 7).alias("k"))


# The Krueger series in powers of the third flattening, with the conformal latitude by its hyperbolic sine.
SQL_UTM = """k AS (SELECT id, 1 / (2 * 298.257223563::DOUBLE - 1) AS n, sin(radians(47 + y / 1000)) AS s, radians(28 + x / 1000 - 27) AS d FROM shapes),
  t AS (SELECT *, sinh(atanh(s) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * s)) AS t, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS r FROM k),
  p AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2,
    61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM t),
  utm AS (SELECT id, 500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) AS east,
    r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) AS north FROM p)"""


@query("pr08_utm", f"WITH {SQL_SHAPES}, {SQL_UTM} SELECT id, round(east, 3) AS east, round(north, 3) AS north, TRUE AS back FROM utm")
def pr08(spark, sf_dir):
    s = shapes(spark, sf_dir).select("id", (28 + F.col("x") / 1000).alias("lon"), (47 + F.col("y") / 1000).alias("lat"))
    x, y = g.to_utm(F.col("lon"), F.col("lat"))
    s = s.withColumn("east", x).withColumn("north", y)
    lon, lat = g.from_utm(F.col("east"), F.col("north"))
    return s.select("id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), (F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat")) < 1e-9).alias("back"))


@query("pr09_mercator", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 64 AS x, o_orderkey * 3 % 64 AS y, 40075016.685578488::DOUBLE / 64 AS size FROM orders)
  SELECT id, round(x * size - 20037508.342789244::DOUBLE, 4) AS x0, round(20037508.342789244::DOUBLE - (y + 1) * size, 4) AS y0, round(x * size / 20037508.342789244::DOUBLE * 180 - 180, 7) AS lon,
    round(degrees(2 * atan(exp((20037508.342789244::DOUBLE - (y + 1) * size) / 20037508.342789244::DOUBLE * pi())) - pi() / 2), 7) AS lat FROM t""")
def pr09(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), g.mercator_bounds(F.lit(6), F.col("o_orderkey") % 64, F.col("o_orderkey") * 3 % 64).alias("b"))
    lon, lat = g.mercator_lon_lat(F.col("b.x0"), F.col("b.y0"))
    return t.select("id", F.round("b.x0", 4).alias("x0"), F.round("b.y0", 4).alias("y0"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("pr10_grid_units", f"WITH {SQL_SHAPES} SELECT id, (629000 + x - 629000) / 51.2::DOUBLE AS gx, (5220000 - (5220000 - y)) / 51.2::DOUBLE AS gy FROM shapes")
def pr10(spark, sf_dir):
    return shapes(spark, sf_dir).select("id", ((629000 + F.col("x") - 629000) / 51.2).alias("gx"), ((5220000 - (5220000 - F.col("y"))) / 51.2).alias("gy"))


@query("pr11_local_frame", f"WITH {SQL_SHAPES} SELECT id, round((x - 10) * 0.6::DOUBLE + (y - 20) * 0.8::DOUBLE, 6) AS along, round((y - 20) * 0.6::DOUBLE - (x - 10) * 0.8::DOUBLE, 6) AS off FROM shapes")
def pr11(spark, sf_dir):
    along, off = g.rotate(F.col("x"), F.col("y"), 10, 20, 0.6, 0.8)
    return shapes(spark, sf_dir).select("id", F.round(along, 6).alias("along"), F.round(off, 6).alias("off"))


@query("pr12_full_map_ids", """SELECT o_orderkey, 'R' || o_custkey AS physical_row_id, 'R' || o_custkey || '-t' || o_orderkey % 311 || '-' || lpad(CAST(row_number() OVER (PARTITION BY o_orderkey % 311 ORDER BY o_orderkey) - 1 AS VARCHAR), 5, '0') AS row_id FROM orders""")
def pr12(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 311).alias("tile"), F.struct("o_orderkey", "o_custkey").alias("f"))
    pos = t.groupBy("tile").agg(F.sort_array(F.collect_list("f")).alias("features")).select("tile", F.posexplode("features").alias("pos", "f"))
    old = F.concat(F.lit("R"), F.col("f.o_custkey").cast("string"))
    source = F.format_string("t%d-%05d", F.col("tile"), F.col("pos"))
    return pos.select("f.o_orderkey", old.alias("physical_row_id"), F.concat_ws("-", old, source).alias("row_id"))


@query("pr14_strip_width", f"WITH {SQL_AREAS} SELECT interrow_id, round((2 * (w + h) - sqrt(greatest(0, 4 * (w + h) * (w + h) - 16 * area_m2))) / 4, 6) AS width FROM areas")
def pr14(spark, sf_dir):
    return areas(spark, sf_dir).select("interrow_id", F.round(g.strip_width((2 * (F.col("w") + F.col("h"))).cast("double"), F.col("area_m2")), 6).alias("width"))


@query("pr15_walking", "SELECT o_orderkey, round(o_totalprice / 1000 / 4 * 60, 6) AS minutes FROM orders")
def pr15(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(tx.walking_minutes(F.col("o_totalprice"), 4), 6).alias("minutes"))


@query("pr16_ring_centre", f"WITH {SQL_SHAPES} SELECT id, (4 * x + 2 * w + 6) / 4 AS cx, (4 * y + 2 * h + 4) / 4 AS cy FROM shapes")
def pr16(spark, sf_dir):
    return shapes(spark, sf_dir).withColumn("c", g.ring_centre(F.col("ring"))).select("id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query("pr18_frames", f"WITH {SQL_SHAPES} SELECT id, greatest(w, h) * 1.3::DOUBLE AS side, x + w / 2 AS cx, greatest(greatest(w, h) * 2.5::DOUBLE, 2.5::DOUBLE) AS loupe FROM shapes")
def pr18(spark, sf_dir):
    b = g.bounds(F.col("line"))
    s = shapes(spark, sf_dir).select("id", b.alias("b")).withColumn("long", F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")))
    return s.select("id", (F.col("long") * 1.3).alias("side"), (F.col("b.x0") + (F.col("b.x1") - F.col("b.x0")) / 2).alias("cx"), F.greatest(F.col("long") * 2.5, F.lit(2.5)).alias("loupe"))


@query("pr19_scale_bar", f"WITH {SQL_SHAPES} SELECT id, COALESCE(list_max(list_filter([10.0::DOUBLE, 20, 50, 100, 200, 500, 1000], lambda s: s <= w * 12 / 4)), 10.0::DOUBLE) AS bar FROM shapes")
def pr19(spark, sf_dir):
    return shapes(spark, sf_dir).select("id", tx.scale_bar(F.col("w") * 12).alias("bar"))


@query("f01_grid_place", f"WITH {SQL_TILES} SELECT name, CAST(regexp_extract(name, '_r(\\d+)_c(\\d+)', 1) AS INTEGER) AS grid_row, CAST(regexp_extract(name, '_r(\\d+)_c(\\d+)', 2) AS INTEGER) AS grid_col FROM tiles")
def f01(spark, sf_dir):
    return tiles(spark, sf_dir).withColumn("g", tx.grid_place(F.col("name"))).select("name", F.col("g.row").alias("grid_row"), F.col("g.col").alias("grid_col"))


@query("a09_grid_layout", f"WITH {SQL_TILES}, g AS (SELECT CAST(regexp_extract(name, '_r(\\d+)_c(\\d+)', 1) AS INTEGER) AS r, CAST(regexp_extract(name, '_r(\\d+)_c(\\d+)', 2) AS INTEGER) AS c FROM tiles) SELECT min(r) AS r0, min(c) AS c0, max(r) - min(r) + 1 AS n_rows, max(c) - min(c) + 1 AS n_cols FROM g")
def a09(spark, sf_dir):
    p = tiles(spark, sf_dir).select(tx.grid_place(F.col("name")).alias("g"))
    return p.agg(F.min("g.row").alias("r0"), F.min("g.col").alias("c0"), (F.max("g.row") - F.min("g.row") + 1).alias("n_rows"), (F.max("g.col") - F.min("g.col") + 1).alias("n_cols"))


@query("f02_file_parts", "SELECT page_id, split_part(url, '://', 1) AS base, split_part(url, '://', 2) AS suffix FROM pages")
def f02(spark, sf_dir):
    parts = F.split("url", "://", 2)
    return read(spark, sf_dir, "pages").select("page_id", parts[0].alias("base"), parts[1].alias("suffix"))


@query("f03_points_text", f"WITH {SQL_SHAPES} SELECT id, printf('%.2f,%.2f;%.2f,%.2f;%.2f,%.2f', x, y, x + w, y, x + w, y + h) AS points, x + w + x + w + x AS sum_x FROM shapes")
def f03(spark, sf_dir):
    s = shapes(spark, sf_dir).withColumn("points", tx.format_points(F.col("line")))
    return s.select("id", "points", F.aggregate(tx.parse_points(F.col("points")), F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x"))


@query("f04_slugs", r"SELECT doc_id, COALESCE(NULLIF(substr(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 32), ''), 'vineyard') AS slug FROM documents")
def f04(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("f05_coordinates", """WITH t AS (SELECT p_partkey AS id, p_partkey % 4 AS form, 47 + (p_partkey % 97) / 128.0::DOUBLE AS a, 28 + (p_partkey % 89) / 128.0::DOUBLE AS b FROM part)
  SELECT id, CASE WHEN form = 3 THEN NULL WHEN form = 2 THEN 'utm' ELSE 'geographic' END AS kind, CASE WHEN form = 2 THEN 600000 + (a - 47) * 128 WHEN form < 2 THEN a END AS a, CASE WHEN form = 2 THEN 5200000 + (b - 28) * 128 WHEN form < 2 THEN b END AS b FROM t""")
def f05(spark, sf_dir):
    k = F.col("p_partkey")
    degrees = lambda low, n: F.format_string("%.7f", low + (k % n) / 128)
    plain = F.concat(degrees(47, 97), F.lit(", "), degrees(28, 89))
    comma = F.concat(F.replace(degrees(47, 97), F.lit("."), F.lit(",")), F.lit("° N "), F.replace(degrees(28, 89), F.lit("."), F.lit(",")), F.lit("° E"))
    utm = F.concat((600_000 + k % 97).cast("string"), F.lit(" "), (5_200_000 + k % 89).cast("string"))
    text = F.element_at(F.array(plain, comma, utm, F.concat(F.lit("plot "), k.cast("string"))), (k % 4 + 1).cast("int"))
    t = read(spark, sf_dir, "part").select(k.alias("id"), tx.read_coordinates(text).alias("c"))
    return t.select("id", "c.kind", "c.a", "c.b")


@query("f06_hectares", r"SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(replace(text, ',', '.'), '(\d{1,12}(?:\.\d{1,4})?)', 1), '') AS DOUBLE) IS NOT NULL AS has_number FROM documents")
def f06(spark, sf_dir):
    found = F.nullif(F.regexp_extract(F.replace("text", F.lit(","), F.lit(".")), r"(\d{1,12}(?:\.\d{1,4})?)", 1), F.lit("")).try_cast("double")
    return read(spark, sf_dir, "documents").select("doc_id", found.isNotNull().alias("has_number"))


@query("f07_collapsed", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def f07(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.collapse(F.col("text")), 256).alias("digest"))


@query("f08_quoted", "SELECT doc_id, length(replace(text, '''', '''''')) AS n FROM documents")
def f08(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.length(tx.quote_literal(F.col("text"))).cast("long").alias("n"))


@query("f09_number_checks", r"SELECT o_orderkey, regexp_matches(CAST(o_orderkey * 123457 + 1000000000 AS VARCHAR), '^\d{10,11}$') AS cadastral FROM orders")
def f09(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.is_cadastral((F.col("o_orderkey") * 123457 + 1_000_000_000).cast("string")).alias("cadastral"))


@query("f10_digests", "SELECT conv_id, turn, sha256(text) AS digest, lower(trim(role)) AS role FROM conversations")
def f10(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"), F.lower(F.trim("role")).alias("role"))


@query("f12_report_numbers", "SELECT event_id, 'VIN-' || upper('s' || user_id) || '-' || strftime(ts, '%Y%m%d') || '-' || strftime(ts, '%H%M') AS report FROM events")
def f12(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", tx.report_number(F.concat(F.lit("s"), F.col("user_id").cast("string")), F.col("ts")).alias("report"))


@query("f13_durations", "SELECT o_orderkey, CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ' min' END AS text FROM (SELECT o_orderkey, CAST(o_orderkey % 500 AS INTEGER) AS m FROM orders)")
def f13(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.duration((F.col("o_orderkey") % 500).cast("double")).alias("text"))


@query("f15_mean_axes", "SELECT l_suppkey, round(((degrees(atan2(sum(sin(2 * radians(a))), sum(cos(2 * radians(a))))) / 2) % 180 + 180) % 180, 6) AS axis FROM (SELECT l_suppkey, CAST(l_partkey % 40 + 10 AS DOUBLE) AS a FROM lineitem) GROUP BY 1")
def f15(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 40 + 10).cast("double").alias("a"))
    return t.groupBy("l_suppkey").agg(F.round(tx.mean_axis(F.col("a")), 6).alias("axis"))


@query("p08_built_up_filter", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin')) AND p_size / 10.0::DOUBLE >= 0.15::DOUBLE")
def p08(spark, sf_dir):
    built = F.contains(F.lower("p_type"), F.lit("steel")) | F.contains(F.lower("p_type"), F.lit("tin"))
    return read(spark, sf_dir, "part").where(~built & (F.col("p_size") / 10 >= 0.15)).select("p_partkey")


@query("p09_bounds_checks", f"WITH {SQL_SHAPES} SELECT id, w / 100 <= 0.1::DOUBLE AND h / 100 <= 0.1::DOUBLE AND x <= x + w AND y <= y + h AS valid FROM shapes")
def p09(spark, sf_dir):
    b = shapes(spark, sf_dir).select("id", "w", "h", g.bounds(F.col("line")).alias("b"))
    return b.select("id", ((F.col("w") / 100 <= 0.1) & (F.col("h") / 100 <= 0.1) & (F.col("b.x0") <= F.col("b.x1")) & (F.col("b.y0") <= F.col("b.y1"))).alias("valid"))


@query("p12_unreachable_targets", """SELECT 'inspection' AS mode, o_orderkey AS target FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'inspection', c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'waste', c_custkey FROM customer WHERE c_acctbal < 0""")
def p12(spark, sf_dir):
    points = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("inspection").alias("mode"), F.col("o_orderkey").alias("target"))
    waste = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.explode(F.array(F.lit("inspection"), F.lit("waste"))).alias("mode"), F.col("c_custkey").alias("target"))
    return points.unionByName(waste)


@query("p15_upload_checks", "SELECT page_id, regexp_matches(url, '\\.html?$') AND length(html) > 0 AND length(html) <= 100000000 AND substr(html, 1, 2) = '<!' AS accepted FROM pages")
def p15(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", (F.col("url").rlike(r"\.html?$") & (F.length("html") > 0) & (F.length("html") <= 100_000_000) & (F.substring("html", 1, 2) == "<!")).alias("accepted"))


@query("p16_assigned", "SELECT o_custkey, bool_or(o_orderkey % 100 = 42) AS assigned FROM orders GROUP BY 1")
def p16(spark, sf_dir):
    d = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct((F.col("o_orderkey") % 100).alias("badge"))).alias("inspectors"))
    return d.select("o_custkey", F.exists("inspectors", lambda i: i["badge"] == 42).alias("assigned"))
