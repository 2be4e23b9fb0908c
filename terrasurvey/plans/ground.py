"""Queries of buffers, headlands, corridors, routes over ground, and masks."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kernel
from ..operators import masks, routes
from ..sources.shared import stored
from .inputs import read
from .registry import query
from .routes import SQL_TERMINALS, cells, terminals


def xy(x, y):
    return F.array(x.cast("double"), y.cast("double"))


def turned(angle, along, across):
    """A point in a frame that is turned by an angle about the origin."""
    return xy(along * F.cos(angle) - across * F.sin(angle), along * F.sin(angle) + across * F.cos(angle))


@query("g07_buffered_roads", """SELECT CAST(p_partkey AS BIGINT) AS site, round(3.0::DOUBLE * p_size + 36 * sin(pi() / 16), 4) AS area FROM part""")
def g07(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    angle = F.col("p_partkey") % 180 * 1.0
    lines = p.select(F.col("p_partkey").cast("long").alias("site"), F.array(xy(F.lit(1.0), F.lit(2.0)), xy(1 + F.col("p_size") * F.cos(F.radians(angle)), 2 + F.col("p_size") * F.sin(F.radians(angle)))).alias("line"))
    areas = routes.road_areas(lines, lines.limit(0).select("site", F.col("line").alias("ring")))
    # one segment a site: the shoelace area of its ring is that of the road
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return areas.groupBy("site").agg(F.round(F.sum(g.area(ring)), 4).alias("area"))


@query("gr10_headlands", """WITH b AS (SELECT n_nationkey AS site, 40 + n_nationkey AS w, 30.0::DOUBLE AS h FROM nation)
  SELECT CAST(site AS BIGINT) AS site, round(w * h - (w - 8 - 0.5) * (24 - 0.5), 4) AS area FROM b""")
def gr10(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"), (40 + F.col("n_nationkey")).cast("double").alias("w"), F.radians(F.col("n_nationkey") * 7.0).alias("t"))
    corner = lambda u, v: turned(F.col("t"), u, v)
    zero, high = F.lit(0.0), F.lit(30.0)
    blocks = n.select("site", F.array(corner(zero, zero), corner(F.col("w"), zero), corner(F.col("w"), high), corner(zero, high)).alias("ring"))
    rows = n.select("site", "w", "t", F.explode(F.array(*[F.lit(3.0 * i) for i in range(1, 10)])).alias("v")).select("site", F.array(corner(F.lit(4.0), F.col("v")), corner(F.col("w") - 4, F.col("v"))).alias("line"))
    area = kernel_area(routes.headland_areas(blocks, rows))
    return area.groupBy("site").agg(F.round(F.sum("area"), 4).alias("area"))


def kernel_area(areas):
    """areas with the area of each ring."""

    def run(batches):
        import numpy as np

        for rows in batches:
            yield rows[["site"]].assign(area=[kernel.union_area([np.array([list(p) for p in r])]) for r in rows["ring"]])

    return areas.select("site", "ring").mapInPandas(run, "site long, area double")


@query("gr11_corridors", """SELECT CAST(p_partkey AS BIGINT) AS site, round((p_size + 3 + 20) * 2.0::DOUBLE, 4) AS area FROM part""")
def gr11(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("site"), (F.col("p_size") + 3).cast("double").alias("w"), F.radians(F.col("p_partkey") % 90 * 1.0).alias("t"))
    corner = lambda u, v: turned(F.col("t"), u, F.lit(v))
    strips = p.select("site", F.array(corner(F.lit(0.0), 0.0), corner(F.col("w"), 0.0), corner(F.col("w"), 2.0), corner(F.lit(0.0), 2.0)).alias("ring"))
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))  # a rectangle
    return routes.corridors(strips).select("site", F.round(g.area(ring), 4).alias("area"))


@query("p07_covered_lines", """WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey % 17 AS DOUBLE) / 2 AS px, CAST(s_suppkey % 13 AS DOUBLE) / 2 AS py, CAST(s_suppkey * 7 % 23 AS DOUBLE) / 2 AS qx, CAST(s_suppkey * 5 % 19 AS DOUBLE) / 2 AS qy FROM supplier)
  SELECT CAST(id AS BIGINT) AS id, greatest(abs(px - 5) + abs(py - 5), abs(qx - 5) + abs(qy - 5)) <= 5 AS covered FROM s""")
def p07(spark, sf_dir):
    import numpy as np

    # a diamond, whose sides are slanted
    diamond = np.array([[0, 5], [5, 0], [10, 5], [5, 10]], float)
    ground = np.array([(x0, x1, *t) for x0, x1, pieces in kernel.slabs([[diamond]], lambda on: on[0]) for t in pieces])
    half = lambda c, m, n: ((F.col(c) * m % n) / 2).cast("double")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), *[half("s_suppkey", m, n).alias(c) for c, m, n in (("px", 1, 17), ("py", 1, 13), ("qx", 7, 23), ("qy", 5, 19))])

    def run(batches):
        for rows in batches:
            found = [kernel.covers_line(ground, np.array([r.px, r.py]), np.array([r.qx, r.qy])) for r in rows.itertuples()]
            yield rows[["id"]].assign(covered=found)

    return s.mapInPandas(run, "id long, covered boolean")


@query("gr04_attached_terminals", f"""WITH {SQL_TERMINALS}, held AS (SELECT *, CASE WHEN y < 20 + k THEN -2.0 ELSE 22.0 + k END AS low, CASE WHEN y < 20 + k THEN 20.0 + k ELSE 62.0 END AS high FROM ends),
  places AS (SELECT DISTINCT site, k, low, y FROM held)
  SELECT h.site, terminal, CAST(3 * k + 0.5 AS DOUBLE) AS x0, CAST(3 * k + 1.5 AS DOUBLE) AS x1, CAST((SELECT count(*) FROM places p WHERE p.site = h.site AND p.k = h.k AND p.low = h.low AND p.y <> h.y AND p.y <> (h.low + h.high) / 2)
    + CASE WHEN h.y = (low + high) / 2 THEN 2 ELSE 3 END AS BIGINT) AS links, round(CAST(abs(y - (low + high) / 2) + 2 * sqrt(0.25 + pow(y - (low + high) / 2, 2)) AS DOUBLE), 6) AS metres FROM held h""")
def gr04(spark, sf_dir):
    """Each target's edges: to the middle of the cell of its lane before or behind the stone, to its two portals, and to the other targets there."""
    links = routes.attached(cells(spark, sf_dir), terminals(spark, sf_dir)).where("terminal <> 0")
    dx = F.abs(F.col("b.x") - F.col("a.x"))
    middle = links.groupBy("site", "terminal").agg(F.min("b.x").alias("x0"), F.max("b.x").alias("x1"), F.count("*").alias("links"), F.min(F.when(dx > 0, F.col("length"))).alias("side"))
    # the two portals and the middle lie at one height
    height = F.sqrt(F.col("side") * F.col("side") - 0.25)
    return middle.select("site", "terminal", "x0", "x1", "links", F.round(height + 2 * F.col("side"), 6).alias("metres"))


@query("gr07_routes", f"""WITH {SQL_TERMINALS} SELECT site, count(DISTINCT (k, y)) AS places, true AS closed, true AS no_longer FROM ends GROUP BY 1""")
def gr07(spark, sf_dir):
    ground = cells(spark, sf_dir)
    edges, places = routes.with_terminals(ground, terminals(spark, sf_dir))
    stops = stored(routes.tours(routes.path_lengths(edges, places)))
    lines = routes.route_lines(routes.expanded(edges, routes.legs_of(stops, places), ground))
    tours = stops.groupBy("site").agg(F.max("length_m").alias("tour_m"))
    # all targets' places are on the route
    passed = lines.select("site", F.explode("points").alias("p")).select("site", "p.x", "p.y").distinct()
    found = places.where("terminal <> 0").select("site", "x", "y").distinct().join(passed, ["site", "x", "y"], "left_semi").groupBy("site").agg(F.count("*").alias("places"))
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    return lines.join(tours, "site").join(found, "site").select("site", "places", closed.alias("closed"), (F.col("length_m") <= F.col("tour_m") + 0.1).alias("no_longer"))


SQL_TRIANGLES = """t AS (SELECT p_partkey AS id, p_partkey % 30 + 0.3::DOUBLE AS x1, p_partkey % 20 + 0.2::DOUBLE AS y1, p_partkey % 30 + 4.1::DOUBLE + p_size % 9 AS x2, p_partkey % 20 + 1.7::DOUBLE AS y2,
  p_partkey % 30 + 2.6::DOUBLE AS x3, p_partkey % 20 + 6.4::DOUBLE + p_size % 5 AS y3 FROM part),
  pixels AS (SELECT id, px, py FROM t, (SELECT unnest(range(64)) AS px), (SELECT unnest(range(40)) AS py)
   WHERE px BETWEEN x1 - 1 AND x2 AND py BETWEEN y1 - 1 AND y3 AND (x2 - x1) * (py + 0.5 - y1) - (y2 - y1) * (px + 0.5 - x1) > 0 AND (x3 - x2) * (py + 0.5 - y2) - (y3 - y2) * (px + 0.5 - x2) > 0
   AND (x1 - x3) * (py + 0.5 - y3) - (y1 - y3) * (px + 0.5 - x3) > 0)"""


def triangle_runs(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b, c = at(k % 30 + 0.3, k % 20 + 0.2), at(k % 30 + 4.1 + s % 9, k % 20 + 1.7), at(k % 30 + 2.6, k % 20 + 6.4 + s % 5)
    return masks.rasterised(read(spark, sf_dir, "part").select(k.alias("id"), F.array(F.array(a, b, c, a)).alias("rings")), ["id"])


@query("g15_rasterised", f"WITH {SQL_TRIANGLES} SELECT id, count(*) AS pixels, CAST(sum(px * 1000 + py) AS BIGINT) AS places FROM pixels GROUP BY 1")
def g15(spark, sf_dir):
    n = F.col("end") - F.col("start")
    places = ((F.col("start") + F.col("end") - 1) * n / 2 * 1000 + F.col("py") * n).cast("long")
    return triangle_runs(spark, sf_dir).groupBy("id").agg(F.sum(n).alias("pixels"), F.sum(places).alias("places"))


@query("i07_outlines", f"""WITH {SQL_TRIANGLES}, holed AS (SELECT * FROM pixels WHERE NOT (px % 5 = 2 AND py % 5 = 3)), sides AS (SELECT *, unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy FROM holed),
  bare AS (SELECT s.id, count(*) AS edge FROM sides s LEFT JOIN holed h ON h.id = s.id AND h.px = s.px + s.dx AND h.py = s.py + s.dy WHERE h.id IS NULL GROUP BY 1)
  SELECT id, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(edge) AS DOUBLE) AS edge FROM holed JOIN bare USING (id) GROUP BY 1""")
def i07(spark, sf_dir):
    pixels = triangle_runs(spark, sf_dir).select("id", "py", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("px")).where("not (px % 5 = 2 and py % 5 = 3)")
    ring = masks.outlines(pixels, ["id"])
    closed = F.concat("ring", F.slice("ring", 1, 1))
    length = F.aggregate(F.zip_with(F.slice(closed, 1, F.size("ring")), F.slice(closed, 2, F.size("ring")), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])), F.lit(0.0), lambda s, x: s + x)
    return ring.groupBy("id").agg(F.sum("area").alias("area"), F.sum(length).alias("edge"))


SQL_SPOTS = """spots AS (SELECT DISTINCT s_nationkey AS tile, c_custkey % 40 AS px, c_custkey * 7 % 23 AS py FROM customer JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON c_nationkey = s_nationkey WHERE c_custkey % 3 > 0)"""


@query("gr03_flood_fill", f"""WITH RECURSIVE {SQL_SPOTS}, fill(tile, px, py) AS (SELECT * FROM spots WHERE px % 11 = 4 UNION SELECT s.tile, s.px, s.py FROM fill f JOIN spots s ON s.tile = f.tile AND abs(s.px - f.px) <= 1 AND abs(s.py - f.py) <= 1)
  SELECT tile, count(*) AS n, CAST(sum(px * 100 + py) AS BIGINT) AS places FROM fill GROUP BY 1""")
def gr03(spark, sf_dir):
    tiles = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tile")).distinct()
    spots = read(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_nationkey").alias("tile"), (F.col("c_custkey") % 40).alias("px"), (F.col("c_custkey") * 7 % 23).alias("py")).distinct().join(tiles, "tile")
    return masks.flooded(spots, spots.where("px % 11 = 4")).groupBy("tile").agg(F.count("*").alias("n"), F.sum(F.col("px") * 100 + F.col("py")).alias("places"))


SQL_PIECES = """p AS (SELECT o_custkey % 20 AS block, o_custkey % 200 AS piece, CAST(o_orderkey % 60 AS DOUBLE) AS px, CAST(o_orderkey % 60 * (o_custkey % 20) // 20 + o_orderkey * 7 % 3 + CASE WHEN o_custkey % 200 % 9 = 5 THEN o_orderkey * 13 % 50 ELSE 0 END AS DOUBLE) AS py FROM orders)"""


@query("i06_row_lines", f"""WITH {SQL_PIECES}, s AS (SELECT block, piece, count(*) AS n, avg(px) AS cx, avg(py) AS cy, var_pop(px) AS xx, var_pop(py) AS yy, covar_pop(px, py) AS xy FROM p GROUP BY 1, 2),
  e AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l1, greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0) AS l2, 0.5::DOUBLE * atan2(2 * xy, xx - yy) AS axis FROM s),
  f AS (SELECT *, 0.5::DOUBLE * atan2(sum(n * sin(2 * axis)) OVER (PARTITION BY block), sum(n * cos(2 * axis)) OVER (PARTITION BY block)) AS main FROM e WHERE n > 1 AND sqrt(l2) <= 0.35::DOUBLE * sqrt(l1)),
  k AS (SELECT *, abs(degrees(axis - main)) % 180 AS off FROM f), m AS (SELECT * FROM k WHERE least(off, 180 - off) <= 8),
  d AS (SELECT block, piece, cx, cy, axis, min((px - cx) * cos(axis) + (py - cy) * sin(axis)) AS a, max((px - cx) * cos(axis) + (py - cy) * sin(axis)) AS b FROM p JOIN m USING (block, piece) GROUP BY ALL)
  SELECT block, piece, round(cx + a * cos(axis), 4) AS x0, round(cy + a * sin(axis), 4) AS y0, round(cx + b * cos(axis), 4) AS x1, round(cy + b * sin(axis), 4) AS y1 FROM d""")
def i06(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    stray = F.when(c % 200 % 9 == 5, o * 13 % 50).otherwise(0)
    p = read(spark, sf_dir, "orders").select((c % 20).alias("block"), (c % 200).alias("piece"), (o % 60).cast("double").alias("px"), (F.floor(o % 60 * (c % 20) / 20) + o * 7 % 3 + stray).cast("double").alias("py"))
    return masks.row_lines(p, "block", "piece").select("block", "piece", *[F.round(x, 4).alias(x) for x in ("x0", "y0", "x1", "y1")])


@query("sc18_downsampled", """SELECT CAST(l_suppkey % 20 AS BIGINT) AS tile, CAST(l_partkey % 97 // 8 AS BIGINT) AS px, CAST(l_orderkey % 89 // 8 AS BIGINT) AS py, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2, 3""")
def sc18(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).cast("long").alias("tile"), (F.col("l_partkey") % 97).alias("px"), (F.col("l_orderkey") % 89).alias("py"), F.col("l_quantity").alias("v"))
    return masks.downsampled(t, ["tile"], 8, "v").withColumn("v", F.round("v", 6))


@query("sc13_precomputed_labels", """SELECT 'siret3_r' || lpad(CAST(p_partkey % 9 AS VARCHAR), 3, '0') || '_c001' AS name, CASE p_partkey % 4 WHEN 0 THEN 'canopy' ELSE 'waste' END AS class, count(*) AS n
  FROM part WHERE p_partkey % 4 < 2 AND p_size % 3 > 0 GROUP BY 1, 2""")
def sc13(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.format_string("siret3_r%03d_c001", (k % 9).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("vineyard", "waste", "row", "dead_vine"))), (k % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("LineString", "Polygon", "MultiPolygon"))), (F.col("p_size") % 3 + 1).cast("int"))
    labels = read(spark, sf_dir, "part").select(name.alias("name"), label.alias("label"), kind.alias("kind"), F.array(xy(F.lit(0), F.lit(0))).alias("ring"))
    return masks.precomputed_features(labels.select("name").distinct(), labels).groupBy("name", "class").agg(F.count("*").alias("n"))
