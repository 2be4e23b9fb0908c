"""Queries over ordered rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import measures, ordered
from .inputs import SQL_AREAS, SQL_SEGMENTS, areas, read, segments
from .registry import query

SQL_GAPS = f"""{SQL_SEGMENTS}, seen AS (SELECT vineyard_id, row_id, a, max(b) OVER (PARTITION BY vineyard_id, row_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
  max(b) OVER (PARTITION BY vineyard_id, row_id) - min(a) OVER (PARTITION BY vineyard_id, row_id) AS row_m FROM segments),
  gaps AS (SELECT vineyard_id, row_id, e AS gap_start, a AS gap_end, a - e AS gap_m, (a + e) / 2 AS middle FROM seen WHERE row_m >= 3 AND a - e >= 1.5)"""


@query("w01_gaps", f"WITH {SQL_GAPS} SELECT * FROM gaps")
def w01(spark, sf_dir):
    return ordered.gaps(segments(spark, sf_dir), ["vineyard_id", "row_id"])


@query("w01_gap_points", f"WITH {SQL_GAPS} SELECT * FROM gaps WHERE gap_m <= 10")
def w01_points(spark, sf_dir):
    return ordered.gaps(segments(spark, sf_dir), ["vineyard_id", "row_id"], "points").where("gap_m >= 1.5")


SQL_BINS = """bins AS (SELECT DISTINCT l_suppkey AS row_id, CAST(l_partkey % 400 AS DOUBLE) / 4 AS pos FROM lineitem)"""


def samples(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row_id"), ((F.col("l_partkey") % 400).cast("double") / 4).alias("at"))


@query("w02_occupancy", f"""WITH {SQL_BINS}, holes AS (SELECT *, pos - lag(pos) OVER (PARTITION BY row_id ORDER BY pos) - 0.25::DOUBLE AS hole FROM bins),
  sums AS (SELECT row_id, max(pos) - min(pos) AS extent, count(*) FILTER (WHERE hole >= 1.5 AND hole <= 10) AS n_gaps, COALESCE(sum(hole) FILTER (WHERE hole >= 1), 0.0::DOUBLE) AS missing FROM holes GROUP BY 1)
  SELECT *, COALESCE(missing / NULLIF(extent, 0) >= 0.1::DOUBLE, FALSE) AS disrupted FROM sums""")
def w02(spark, sf_dir):
    return ordered.occupancy(samples(spark, sf_dir), ["row_id"], "at", 0.25)


@query("a18_smoothed_histogram", """WITH counts AS (SELECT l_suppkey AS row_id, CAST(floor((l_partkey % 400) / 8.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
  spread AS (SELECT row_id, bin + d AS bin, n * (CASE abs(d) WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END) AS v FROM counts, (SELECT unnest(range(-2, 3)) AS d))
  SELECT s.row_id, s.bin, COALESCE(c.n, 0) AS n, s.smooth FROM (SELECT row_id, bin, sum(v) AS smooth FROM spread GROUP BY 1, 2) s LEFT JOIN counts c USING (row_id, bin)""")
def a18(spark, sf_dir):
    from ..operators.raster import histogram

    t = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.floor((F.col("l_partkey") % 400) / 8).cast("long").alias("bin"))
    return ordered.smoothed(t.groupBy("row_id", "bin").agg(F.count("*").alias("n")), ["row_id"], [0.5, 0.25, 0.125])


@query("w03_peaks", """WITH RECURSIVE counts AS (SELECT l_suppkey AS row_id, CAST(floor((l_partkey % 400) / 8.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
  curve AS (SELECT row_id, bin + d AS bin, sum(n * (CASE abs(d) WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END)) AS smooth FROM counts, (SELECT unnest(range(-2, 3)) AS d) GROUP BY 1, 2),
  levels AS (SELECT row_id, quantile_cont(smooth, 0.95) AS level FROM curve WHERE smooth > 0 GROUP BY 1),
  steps AS (SELECT *, COALESCE(lag(smooth) OVER w, 0) AS before, COALESCE(lead(smooth) OVER w, 0) AS after FROM curve WINDOW w AS (PARTITION BY row_id ORDER BY bin)),
  tops AS (SELECT row_id, bin, smooth, row_number() OVER (PARTITION BY row_id ORDER BY smooth DESC, bin) AS place FROM steps JOIN levels USING (row_id) WHERE smooth >= before AND smooth > after AND smooth >= 0.15::DOUBLE * level),
  picked(row_id, place, kept) AS (SELECT row_id, place, [bin] FROM tops WHERE place = 1
    UNION ALL SELECT t.row_id, t.place, CASE WHEN len(list_filter(p.kept, lambda k: abs(t.bin - k) < 3)) = 0 THEN list_append(p.kept, t.bin) ELSE p.kept END FROM picked p JOIN tops t ON t.row_id = p.row_id AND t.place = p.place + 1),
  last AS (SELECT row_id, unnest(arg_max(kept, place)) AS bin FROM picked GROUP BY row_id)
  SELECT row_id, bin, smooth FROM last JOIN tops USING (row_id, bin)""")
def w03(spark, sf_dir):
    return ordered.peaks(a18(spark, sf_dir), ["row_id"], 3)


@query("a21_median_spacing", """WITH rows AS (SELECT DISTINCT c_nationkey AS block, CAST(c_custkey % 500 AS DOUBLE) / 4 AS off FROM customer), steps AS (SELECT block, off - lag(off) OVER (PARTITION BY block ORDER BY off) AS step FROM rows)
  SELECT block, COALESCE(median(step), 2.5::DOUBLE) AS spacing FROM steps GROUP BY 1""")
def a21(spark, sf_dir):
    return ordered.median_spacing(offsets(spark, sf_dir), ["block"], "off")


def offsets(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), ((F.col("c_custkey") % 500).cast("double") / 4).alias("off")).distinct()


@query("w07_strips", """WITH rows AS (SELECT DISTINCT c_nationkey AS block, CAST(c_custkey % 500 AS DOUBLE) / 4 AS off FROM customer),
  pairs AS (SELECT block, off AS from_offset, lead(off) OVER (PARTITION BY block ORDER BY off) AS to_offset FROM rows), m AS (SELECT block, median(to_offset - from_offset) AS spacing FROM pairs GROUP BY 1)
  SELECT p.block, from_offset, to_offset, to_offset - from_offset AS width FROM pairs p JOIN m USING (block) WHERE to_offset IS NOT NULL AND to_offset - from_offset <= 2.6::DOUBLE * spacing""")
def w07(spark, sf_dir):
    return ordered.strips(offsets(spark, sf_dir), ["block"], "off")


@query("w08_interrow_quads", """WITH rows AS (SELECT c_nationkey AS block, CAST(c_custkey % 500 AS DOUBLE) / 4 AS off, CAST(min(c_custkey % 31) AS DOUBLE) AS f, CAST(max(c_custkey % 31 + 90) AS DOUBLE) AS l FROM customer GROUP BY 1, 2),
  pairs AS (SELECT *, lead(off) OVER w AS nx, lead(f) OVER w AS nf, lead(l) OVER w AS nl FROM rows WINDOW w AS (PARTITION BY block ORDER BY off)),
  split AS (SELECT *, greatest(1, CAST(round_even((nx - off) / 2.5::DOUBLE, 0) AS INTEGER)) AS k FROM pairs WHERE nx IS NOT NULL AND nx - off >= 1)
  SELECT block, off AS row_offset, CAST(piece AS INTEGER) AS piece, off + (nx - off) * piece / k AS from_offset, off + (nx - off) * (piece + 1) / k AS to_offset, least(f, nf) - 15 AS from_along, greatest(l, nl) + 15 AS to_along
  FROM (SELECT *, unnest(range(k)) AS piece FROM split WHERE (nx - off) / k <= 4.5::DOUBLE)""")
def w08(spark, sf_dir):
    t = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("block"), ((F.col("c_custkey") % 500).cast("double") / 4).alias("off")).agg(F.min(F.col("c_custkey") % 31).cast("double").alias("f"), F.max(F.col("c_custkey") % 31 + 90).cast("double").alias("l"))
    return ordered.interrow_quads(t, ["block"], "off", "f", "l", 2.5)


@query("w09_row_names", """SELECT block, off, 'V' || block || '-R' || lpad(CAST(row_number() OVER (PARTITION BY block ORDER BY off) AS VARCHAR), 3, '0') AS row_name FROM (SELECT DISTINCT c_nationkey AS block, CAST(c_custkey % 500 AS DOUBLE) / 4 AS off FROM customer)""")
def w09(spark, sf_dir):
    t = offsets(spark, sf_dir).withColumn("v", F.concat(F.lit("V"), F.col("block").cast("string")))
    return ordered.named(t, ["v"], "off").drop("v")


@query("t01_top_gaps", f"WITH {SQL_GAPS} SELECT * FROM gaps ORDER BY gap_m DESC, vineyard_id, row_id, gap_start LIMIT 160")
def t01(spark, sf_dir):
    return ordered.top_gaps(w01(spark, sf_dir), 40, ["vineyard_id", "row_id", "gap_start"])


@query("t02_inspection_points", f"""WITH {SQL_GAPS}, waste AS (SELECT p_partkey AS k FROM part WHERE p_type = 'PROMO'),
  w AS (SELECT 'W-' || lpad(CAST(n AS VARCHAR), 3, '0') AS name, CAST(k AS VARCHAR) AS key FROM (SELECT k, row_number() OVER (ORDER BY k) AS n FROM waste) WHERE n <= 100),
  g AS (SELECT *, row_number() OVER (ORDER BY gap_m DESC, vineyard_id, row_id, gap_start) AS n FROM gaps), room AS (SELECT least(60, 200 - count(*)) AS r FROM w)
  SELECT * FROM w UNION ALL SELECT 'IP-' || lpad(CAST(row_number() OVER (ORDER BY vineyard_id, row_id, gap_start) AS VARCHAR), 3, '0'), vineyard_id || ':' || row_id || ':' || CAST(gap_start AS VARCHAR) FROM g, room WHERE n <= r""")
def t02(spark, sf_dir):
    waste = read(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("waste_key"))
    return ordered.inspection_points(waste, w01(spark, sf_dir), ["vineyard_id", "row_id", "gap_start"])


@query("t03_ranked_parcels", """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS cadastral_number, p_size / 10.0::DOUBLE AS area_ha, CASE p_partkey % 6 WHEN 0 THEN 'Agricultural' WHEN 1 THEN 'Under CONSTRuction' WHEN 2 THEN NULL WHEN 3 THEN 'road' ELSE 'garden' END AS land_use FROM part),
  ok AS (SELECT * FROM p WHERE area_ha >= 0.15::DOUBLE AND NOT COALESCE(contains(lower(land_use), 'constr') OR contains(lower(land_use), 'building') OR contains(lower(land_use), 'road') OR contains(lower(land_use), 'urban'), FALSE)),
  r AS (SELECT *, row_number() OVER (ORDER BY COALESCE(contains(lower(land_use), 'agric'), FALSE) DESC, area_ha DESC, cadastral_number) AS place, count(*) OVER () > 200 AS is_truncated FROM ok)
  SELECT cadastral_number, area_ha, land_use, CAST(place AS INTEGER) AS place, is_truncated FROM r WHERE place <= 200""")
def t03(spark, sf_dir):
    use = F.element_at(F.array(*[F.lit(x) for x in ("Agricultural", "Under CONSTRuction", None, "road", "garden", "garden")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("cadastral_number"), (F.col("p_size") / 10).alias("area_ha"), use.alias("land_use"))
    return ordered.ranked_parcels(p)


@query("t05_largest_part", f"WITH {SQL_AREAS} SELECT vineyard_id, arg_max(interrow_id, {{'a': area_m2, 'b': interrow_id}}) AS interrow_id, max(area_m2) AS area_m2 FROM areas GROUP BY 1")
def t05(spark, sf_dir):
    return areas(spark, sf_dir).groupBy("vineyard_id").agg(F.max_by("interrow_id", F.struct("area_m2", "interrow_id")).alias("interrow_id"), F.max("area_m2").alias("area_m2"))


@query("t06_richest_block", f"WITH {SQL_AREAS}, b AS (SELECT vineyard_id, count(*) FILTER (WHERE label = 'waste') AS targets, CAST(sum(area_m2) AS BIGINT) AS area FROM areas WHERE vineyard_id IS NOT NULL GROUP BY 1) SELECT * FROM b ORDER BY targets DESC, area DESC, vineyard_id DESC LIMIT 1")
def t06(spark, sf_dir):
    b = areas(spark, sf_dir).where("vineyard_id is not null").groupBy("vineyard_id").agg(F.count_if(F.col("label") == "waste").alias("targets"), F.sum("area_m2").alias("area"))
    return b.agg(F.max(F.struct("targets", "area", "vineyard_id")).alias("b")).select("b.vineyard_id", "b.targets", "b.area")


@query("t07_south_west", f"WITH {SQL_AREAS} SELECT vineyard_id, arg_min(x, {{'y': y, 'x': x}}) AS x, min(y) AS y FROM areas GROUP BY 1")
def t07(spark, sf_dir):
    return areas(spark, sf_dir).groupBy("vineyard_id").agg(F.min_by("x", F.struct("y", "x")).alias("x"), F.min("y").alias("y"))


@query("t08_cap", "SELECT count(*) AS n FROM part")
def t08(spark, sf_dir):
    n = read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return n.select(F.when(F.col("n") <= 50_000_000, F.col("n")).otherwise(F.raise_error(F.lit("more features than the cap allows"))).cast("long").alias("n"))


SQL_PATH = """path AS (SELECT o_custkey AS route_id, o_orderkey AS pos, CAST(o_orderkey * 7 % 60 AS DOUBLE) AS x, CAST(o_orderkey * 11 % 47 AS DOUBLE) AS y FROM orders)"""


def path(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") * 7 % 60).cast("double").alias("x"), (F.col("o_orderkey") * 11 % 47).cast("double").alias("y"))


@query("w05_first_entry", f"""WITH {SQL_PATH}, seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM path WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
  s AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM seg WHERE x2 IS NOT NULL),
  d AS (SELECT *, COALESCE(sum(len) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
  t AS (SELECT s_suppkey AS target_id, CAST(s_suppkey * 13 % 61 AS DOUBLE) AS tx, CAST(s_suppkey * 17 % 43 AS DOUBLE) AS ty FROM supplier),
  m AS (SELECT route_id, target_id, before, len, (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) AS a, (x - tx) * (x2 - x) + (y - ty) * (y2 - y) AS b,
    (x - tx) * (x - tx) + (y - ty) * (y - ty) - 4 AS c FROM d, t),
  r AS (SELECT *, (-b - sqrt(greatest(b * b - a * c, 0))) / nullif(a, 0) AS place FROM m),
  e AS (SELECT *, CASE WHEN c <= 1e-9 THEN 0.0::DOUBLE WHEN b * b - a * c >= -1e-9 AND place BETWEEN -1e-9 AND 1 + 1e-9 THEN greatest(0, least(1, place)) END AS t FROM r)
  SELECT route_id, target_id, round(min(before + t * len), 6) AS distance_m FROM e WHERE t IS NOT NULL GROUP BY 1, 2""")
def w05(spark, sf_dir):
    t = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") * 13 % 61).cast("double").alias("x"), (F.col("s_suppkey") * 17 % 43).cast("double").alias("y"))
    return ordered.first_entry(path(spark, sf_dir), t, digits=6)


@query("w06_vertex_pairs", f"""WITH {SQL_PATH} SELECT * FROM (SELECT route_id, pos AS "at", x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM path WINDOW w AS (PARTITION BY route_id ORDER BY pos)) WHERE x2 IS NOT NULL""")
def w06(spark, sf_dir):
    order = Window.partitionBy("route_id").orderBy("at")
    return path(spark, sf_dir).select("route_id", "at", "x", "y", F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 is not null")


@query("w11_claimed_pixels", """WITH RECURSIVE q AS (SELECT l_suppkey % 20 AS tile, l_partkey % 30 AS quad, list(DISTINCT l_orderkey % 900) AS px FROM lineitem GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY quad) AS k FROM q),
  f AS (SELECT tile, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS quad, CAST([] AS BIGINT[]) AS mine, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT tile FROM o)
    UNION ALL SELECT tile, k, quad, free, CASE WHEN len(free) >= 20 THEN list_concat(taken, free) ELSE taken END
    FROM (SELECT o.tile, o.k, o.quad, f.taken, list_filter(o.px, lambda x: NOT list_contains(f.taken, x)) AS free FROM f JOIN o ON o.tile = f.tile AND o.k = f.k + 1))
  SELECT tile, quad, CAST(len(mine) AS BIGINT) AS pixels FROM f WHERE k > 0 AND len(mine) >= 20""")
def w11(spark, sf_dir):
    quads = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("tile"), (F.col("l_partkey") % 30).alias("quad"), (F.col("l_orderkey") % 900).alias("pixel"))
    return ordered.claimed(quads, ["tile"], 20)
