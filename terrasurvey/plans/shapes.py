"""Queries over slanted, crossing and overlapping shapes."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import lines, overlay, segments, slanted, thinning
from ..sources.shared import spread
from .ground import SQL_TRIANGLES
from .inputs import SQL_AREAS, areas, read
from .ordered import SQL_PATH, path
from .registry import query
from .spatial import SQL_BOXES, boxes

#: A box (u, v) turned by 45 degrees: x = (u + v) / 2, y = (u - v) / 2, so lengths are those of the box divided by the root of 2.
SQL_FAR = "sqrt((pow(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + pow(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2)) / 2)"


def turned(spark, sf_dir, label):
    """(id, ring) of the boxes of a label, turned by 45 degrees."""
    at = lambda u, v: F.struct(((F.col(u) + F.col(v)) / 2).alias("x"), ((F.col(u) - F.col(v)) / 2).alias("y"))
    return boxes(spark, sf_dir).where(F.col("label") == label).select("id", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0")).alias("ring"))


@query("j11_slanted_clips", f"""WITH {SQL_BOXES} SELECT a.id, b.id AS r_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 2, 6) AS area FROM boxes a, boxes b
  WHERE a.label = 'vineyard' AND b.label = 'interrow_area' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def j11_slanted(spark, sf_dir):
    return slanted.common_areas(turned(spark, sf_dir, "vineyard"), turned(spark, sf_dir, "interrow_area")).withColumn("area", F.round("area", 6))


@query("j12_slanted_distances", f"""WITH {SQL_BOXES} SELECT a.id, b.id AS r_id, round({SQL_FAR}, 6) AS distance FROM boxes a, boxes b WHERE a.label = 'vineyard' AND b.label = 'waste' AND {SQL_FAR} <= 3.01""")
def j12_slanted(spark, sf_dir):
    return slanted.distances(turned(spark, sf_dir, "vineyard"), turned(spark, sf_dir, "waste"), 3.01).withColumn("distance", F.round("distance", 6))


@query("j15_slanted_clusters", f"""WITH RECURSIVE {SQL_BOXES}, v AS (SELECT * FROM boxes WHERE label = 'waste'), e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON {SQL_FAR} <= 1.01),
  reach(id, seen) AS (SELECT id, id FROM v UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.seen),
  c AS (SELECT id, min(seen) AS cluster FROM reach GROUP BY 1), sizes AS (SELECT cluster, sum((x1 - x0) * (y1 - y0)) / 2 AS area FROM c JOIN v USING (id) GROUP BY 1)
  SELECT id, cluster FROM c JOIN sizes USING (cluster) WHERE area >= 8.25""")
def j15_slanted(spark, sf_dir):
    return slanted.polygon_clusters(turned(spark, sf_dir, "waste"), 1.01, 8.25)


@query("sc05_repaired_rings", f"""WITH {SQL_AREAS} SELECT interrow_id AS id, CAST(2 AS INTEGER) AS parts, round(w * h / 2, 6) AS area, round(w * h / 4, 6) AS largest FROM areas""")
def sc05_repaired(spark, sf_dir):
    """Rings that cross themselves in the middle of a box: two triangles each."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    bow = F.array(g.point(x, y), g.point(x + w, y + h), g.point(x + w, y), g.point(x, y + h), g.point(x, y))
    parts = overlay.repaired(areas(spark, sf_dir).select(F.col("interrow_id").alias("id"), bow.alias("ring")))
    size = F.transform("parts", lambda p: p["area"])
    total = F.aggregate(size, F.lit(0.0), lambda s, a: s + a)
    return parts.select("id", F.size("parts").alias("parts"), F.round(total, 6).alias("area"), F.round(F.array_max(size), 6).alias("largest"))


@query("a15_dissolved_blocks", f"""WITH {SQL_AREAS}, cells AS (SELECT DISTINCT COALESCE(vineyard_id, '') AS block, x + i AS px, y + j AS py FROM (SELECT *, unnest(range(w)) AS i FROM areas), (SELECT unnest(range(11)) AS j) WHERE j < h),
  sides AS (SELECT *, unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy FROM cells),
  bare AS (SELECT s.block, count(*) AS n FROM sides s LEFT JOIN cells c ON c.block = s.block AND c.px = s.px + s.dx AND c.py = s.py + s.dy WHERE c.px IS NULL GROUP BY 1)
  SELECT block, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(n) AS DOUBLE) AS border FROM cells JOIN bare USING (block) GROUP BY 1""")
def a15_dissolved(spark, sf_dir):
    """The union of each block's boxes as rings with holes: its area and the length of its border."""
    x, y, w, h = (F.col(c) for c in "xywh")
    shapes = areas(spark, sf_dir).select(F.coalesce("vineyard_id", F.lit("")).alias("block"), F.lit(0).alias("layer"), F.col("interrow_id").alias("shape"), g.box_ring(x, y, w, h).alias("ring"))
    parts = overlay.dissolved(shapes, ["block"])
    length = g.length(F.col("outer")) + F.aggregate(F.transform("holes", g.length), F.lit(0.0), lambda s, v: s + v)
    return parts.groupBy("block").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum(length), 6).alias("border"))


@query("w12_slanted_pieces", f"""WITH {SQL_PATH}, s AS (SELECT route_id, row_number() OVER w - 1 AS segment, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM path WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
  u AS (SELECT route_id, segment, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len, least(x + y, x2 + y2) AS a, greatest(x + y, x2 + y2) AS b FROM s WHERE x2 IS NOT NULL AND (x <> x2 OR y <> y2)),
  p AS (SELECT *, 20 * j - 11.5 AS lo, 20 * j + 0.5 AS hi FROM u, (SELECT unnest(range(7)) AS j)),
  q AS (SELECT *, CASE WHEN a = b THEN CASE WHEN a > lo AND a < hi THEN len ELSE 0 END ELSE greatest(0, least(b, hi) - greatest(a, lo)) * len / (b - a) END AS metres FROM p)
  SELECT route_id, CAST(segment AS INTEGER) AS segment, count(*) AS pieces, round(CAST(sum(metres) AS DOUBLE), 6) AS outside_m FROM q WHERE metres > 1e-9 GROUP BY 1, 2""")
def w12_slanted(spark, sf_dir):
    """Pieces of bent routes outside six slanted strips, each segment as often as it is walked."""
    at = lambda u, v: F.struct(F.lit((u + v) / 2).alias("x"), F.lit((u - v) / 2).alias("y"))
    strip = lambda lo, hi: F.array(at(lo, -200), at(hi, -200), at(hi, 200), at(lo, 200), at(lo, -200))
    strips = spark.range(1).select(F.explode(F.array(*[strip(20 * j + 0.5, 20 * j + 8.5) for j in range(6)])).alias("ring"))
    routes = path(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
    found = lines.pieces_outside(routes.select("route_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points")), strips, "route_id")
    return found.groupBy("route_id", "segment").agg(F.count("*").alias("pieces"), F.round(F.sum("length_m"), 6).alias("outside_m"))


SQL_BENT = """l AS (SELECT p_partkey AS id, CAST(p_partkey % 30 AS DOUBLE) AS x1, CAST(p_partkey % 23 AS DOUBLE) AS y1, CAST(p_partkey % 30 + p_size % 17 + 3 AS DOUBLE) AS x2, CAST(p_partkey % 23 + p_size % 5 AS DOUBLE) AS y2, CAST(p_partkey % 30 + 8 AS DOUBLE) AS x3, CAST(p_partkey % 23 + 30 AS DOUBLE) AS y3 FROM part),
  s AS (SELECT id, 0 AS segment, x1 AS px, y1 AS py, x2 AS qx, y2 AS qy FROM l UNION ALL SELECT id, 1, x2, y2, x3, y3 FROM l),
  c AS (SELECT *, CAST(greatest(ceil(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))), 1) AS BIGINT) AS n FROM s),
  d AS (SELECT id, segment, i, px + (qx - px) * i / n AS x, py + (qy - py) * i / n AS y FROM (SELECT *, unnest(range(n + segment)) AS i FROM c))"""


@query("g11_brushed_lines", f"""WITH {SQL_BENT}, m AS (SELECT *, (x - 20.137) * (x - 20.137) + (y - 12.291) * (y - 12.291) <= 9 OR (x - 23.137) * (x - 23.137) + (y - 16.291) * (y - 16.291) <= 9 AS gone FROM d),
  k AS (SELECT *, count(*) FILTER (gone) OVER (PARTITION BY id ORDER BY segment, i) AS piece FROM m), r AS (SELECT id, piece, count(*) AS n, sum(x) AS sx FROM k WHERE NOT gone GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT id, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS points, round(sum(sx), 3) AS places FROM r GROUP BY 1""")
def g11_brushed(spark, sf_dir):
    """What two strokes of a brush leave of bent lines."""
    k, size = F.col("p_partkey"), F.col("p_size")
    bent = F.array(g.point(k % 30, k % 23), g.point(k % 30 + size % 17 + 3, k % 23 + size % 5), g.point(k % 30 + 8, k % 23 + 30))
    discs = spark.createDataFrame([(20.137, 12.291), (23.137, 16.291)], "x double, y double")
    left = lines.brushed(read(spark, sf_dir, "part").select(k.alias("id"), bent.alias("points")), discs, "id", 3.0)
    total = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["x"])
    return left.select("id", F.size("points").cast("long").alias("n"), total.alias("sx")).groupBy("id").agg(F.count("*").alias("pieces"), F.sum("n").alias("points"), F.round(F.sum("sx"), 3).alias("places"))


@query("g16_sampled_polygons", f"""WITH {SQL_TRIANGLES.split("pixels AS")[0].rstrip().rstrip(",")}, b AS (SELECT *, least(x1, x2, x3) AS x0, least(y1, y2, y3) AS y0 FROM t),
  p AS (SELECT *, x0 + (i + 0.5) * 0.25::DOUBLE AS x, y0 + (j + 0.5) * 0.25::DOUBLE AS y FROM b, (SELECT unnest(range(56)) AS i), (SELECT unnest(range(48)) AS j))
  SELECT id, count(*) AS n, round(sum(x), 4) AS sx FROM p WHERE (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0 AND (x3 - x2) * (y - y2) - (y3 - y2) * (x - x2) > 0 AND (x1 - x3) * (y - y3) - (y1 - y3) * (x - x3) > 0 GROUP BY 1""")
def g16_polygons(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b, c = g.point(k % 30 + 0.3, k % 20 + 0.2), g.point(k % 30 + 4.1 + s % 9, k % 20 + 1.7), g.point(k % 30 + 2.6, k % 20 + 6.4 + s % 5)
    found = segments.sampled_polygons(read(spark, sf_dir, "part").select(k.alias("id"), F.array(a, b, c, a).alias("ring")), "id")
    return found.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"))


@query("i06_split_rows", """SELECT s_suppkey AS tile, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS n, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 11.5 ELSE 73 END AS DOUBLE) AS places, true AS whole FROM supplier""")
def i06_split(spark, sf_dir):
    """Masks of one row, or of two that a bridge joins: their middle lines, nearly as long as the mask."""
    k = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"), (300 + F.col("s_suppkey") % 7 * 10).alias("long"))
    box = lambda x0, x1, y0, y1: F.struct(F.lit(x0).cast("long").alias("x0"), x1.cast("long").alias("x1"), F.lit(y0).alias("y0"), F.lit(y1).alias("y1"))
    rows = F.when(F.col("tile") % 3 == 0, F.array(box(0, F.col("long"), 10, 12))).otherwise(F.array(box(0, F.col("long"), 10, 12), box(0, F.col("long"), 60, 62), box(100, F.lit(102), 13, 59)))
    # a small file of tiles is read by one task, their pixels are made by many
    pixels = spread(k, "tile").select("tile", F.explode(rows).alias("b")).select("tile", F.explode(F.sequence("b.x0", "b.x1")).alias("px"), "b.y0", "b.y1").select("tile", "px", F.explode(F.sequence("y0", "y1")).alias("py"))
    found = thinning.split_rows(pixels, "tile")
    n = found.groupBy("tile").agg(F.count("*").cast("int").alias("n"), F.round(F.sum("y0"), 2).alias("places"), F.min(F.col("x1") - F.col("x0")).alias("least"))
    return n.join(k, "tile").select("tile", "n", "places", (F.col("least") > F.col("long") - 8).alias("whole"))
