"""Queries of measurements and summaries."""

from pyspark.sql import functions as F

from ..operators import measures
from .inputs import SQL_AREAS, SQL_SEGMENTS, areas, read, segments
from .registry import query

SQL_ROWS = f"""{SQL_SEGMENTS}, sized AS (
  SELECT vineyard_id, row_id, a, b, max(b) OVER (PARTITION BY vineyard_id, row_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM segments
), stretches AS (
  SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY vineyard_id, row_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM sized
), lengths AS (
  SELECT vineyard_id, row_id, sum(len) AS row_length_m FROM (SELECT vineyard_id, row_id, k, max(b) - min(a) AS len FROM stretches GROUP BY ALL) GROUP BY ALL
), votes AS (SELECT vineyard_id, row_id, row_structure, count(*) AS n FROM segments GROUP BY ALL
), best AS (
  SELECT vineyard_id, row_id, row_structure, row_number() OVER (PARTITION BY vineyard_id, row_id ORDER BY (row_structure = 'disrupted') DESC, n DESC, row_structure) AS k FROM votes
), line AS (SELECT l.vineyard_id, l.row_id, l.row_length_m, b.row_structure FROM lengths l JOIN best b USING (vineyard_id, row_id) WHERE b.k = 1)"""

SQL_CELLS = f"""{SQL_AREAS}, cells AS (SELECT vineyard_id, label, x + i AS px, y + j AS py FROM (SELECT *, unnest(range(w)) AS i FROM areas), (SELECT unnest(range(11)) AS j) WHERE j < h)"""


@query("a05_measurements", f"""WITH {SQL_ROWS}, {SQL_CELLS}, canopy AS (SELECT vineyard_id, count(DISTINCT px * 1000 + py) AS m2 FROM cells WHERE label = 'vineyard' AND vineyard_id IS NOT NULL GROUP BY 1),
  lanes AS (SELECT vineyard_id, count(DISTINCT px * 1000 + py) AS m2 FROM cells WHERE label = 'interrow_area' AND vineyard_id IS NOT NULL GROUP BY 1),
  byblock AS (SELECT vineyard_id, count(*) AS n, sum(row_length_m) AS m FROM line WHERE vineyard_id <> '' GROUP BY 1),
  blocks AS (SELECT COALESCE(b.vineyard_id, c.vineyard_id) AS vineyard_id, COALESCE(b.n, 0) AS n, COALESCE(b.m, 0) AS m, COALESCE(c.m2, 0) AS c FROM byblock b FULL JOIN canopy c ON b.vineyard_id = c.vineyard_id),
  lines AS (
    SELECT 0 AS rank, 'total' AS level, NULL AS vineyard_id, NULL AS row_id, NULL AS row_structure, (SELECT count(*) FROM line) AS row_count, (SELECT sum(row_length_m) FROM line WHERE vineyard_id <> '') AS len,
      (SELECT count(DISTINCT px * 1000 + py) FROM cells WHERE label = 'vineyard') AS c, (SELECT count(DISTINCT px * 1000 + py) FROM cells WHERE label = 'interrow_area' AND vineyard_id IS NOT NULL) AS i, (SELECT count(*) FROM blocks) AS block_count
    UNION ALL SELECT 1, 'block', k.vineyard_id, NULL, NULL, k.n, k.m, k.c, COALESCE(l.m2, 0), NULL FROM blocks k LEFT JOIN lanes l USING (vineyard_id)
    UNION ALL SELECT 2, 'row', vineyard_id, row_id, row_structure, NULL, row_length_m, NULL, NULL, NULL FROM line WHERE vineyard_id <> '')
  SELECT rank, level, vineyard_id, row_id, row_structure, row_count, round(CAST(len AS DOUBLE), 2) AS row_length_m, CAST(c AS DOUBLE) AS canopy_area_m2, round(c / 10000.0::DOUBLE, 4) AS canopy_area_ha,
    CAST(i AS DOUBLE) AS interrow_area_m2, round(i / 10000.0::DOUBLE, 4) AS interrow_area_ha, block_count FROM lines""")
def a05(spark, sf_dir):
    return measures.measurements(segments(spark, sf_dir), areas(spark, sf_dir))


@query("a06_structure_votes", f"WITH {SQL_ROWS} SELECT vineyard_id, row_id, row_structure FROM line")
def a06(spark, sf_dir):
    return measures.row_lengths(segments(spark, sf_dir)).select("vineyard_id", "row_id", "row_structure")


@query("a07_survey_summary", f"""WITH {SQL_ROWS}, {SQL_AREAS}, keyed AS (SELECT NULLIF(vineyard_id, '') AS v, * FROM line),
  keys AS (SELECT 'V' || lpad(CAST(n_nationkey * 2 AS VARCHAR), 2, '0') AS v FROM nation UNION SELECT vineyard_id FROM areas UNION SELECT v FROM keyed)
  SELECT k.v AS vineyard_id, COALESCE(r.n, 0) AS n_rows, COALESCE(r.d, 0) AS n_disrupted, COALESCE(a.nv, 0) AS n_vineyard, COALESCE(a.ni, 0) AS n_interrow_area, COALESCE(a.nw, 0) AS n_waste,
    CAST(COALESCE(a.m2, 0) AS BIGINT) AS canopy_m2, round(COALESCE(r.m, 0.0::DOUBLE), 2) AS length_m
  FROM keys k LEFT JOIN (SELECT v, count(*) AS n, count(*) FILTER (WHERE row_structure = 'disrupted') AS d, sum(row_length_m) AS m FROM keyed GROUP BY 1) r ON r.v IS NOT DISTINCT FROM k.v
  LEFT JOIN (SELECT vineyard_id, count(*) FILTER (WHERE label = 'vineyard') AS nv, count(*) FILTER (WHERE label = 'interrow_area') AS ni, count(*) FILTER (WHERE label = 'waste') AS nw, sum(area_m2) FILTER (WHERE label = 'vineyard') AS m2 FROM areas GROUP BY 1) a
    ON a.vineyard_id IS NOT DISTINCT FROM k.v""")
def a07(spark, sf_dir):
    blocks = read(spark, sf_dir, "nation").select(F.format_string("V%02d", (F.col("n_nationkey") * 2).cast("int")).alias("vineyard_id"))
    return measures.survey_summary(blocks, measures.row_lengths(segments(spark, sf_dir)), areas(spark, sf_dir))


@query("a08_row_groups", f"""WITH {SQL_ROWS} SELECT * FROM (SELECT vineyard_id, count(*) FILTER (WHERE row_structure IN ('disrupted', 'unassessable')) AS n_shown,
  round(sum(row_length_m) FILTER (WHERE row_structure IN ('disrupted', 'unassessable')), 2) AS shown_m, count(*) AS n_all, count(*) FILTER (WHERE row_structure = 'disrupted') AS n_disrupted,
  count(*) FILTER (WHERE row_structure = 'regular') AS n_regular FROM line GROUP BY 1) WHERE n_shown > 0""")
def a08(spark, sf_dir):
    return measures.row_groups(measures.row_lengths(segments(spark, sf_dir)), ["disrupted", "unassessable"])


@query("a10_interrow_groups", f"""WITH {SQL_AREAS} SELECT COALESCE(vineyard_id, 'unassigned') AS key, count(*) AS n, CAST(sum(area_m2) AS BIGINT) AS area_m2, round(sum(width_m) / greatest(1, count(*)), 4) AS mean_width_m,
  count(*) FILTER (WHERE cover = 'bare_soil') AS n_bare_soil, count(*) FILTER (WHERE cover = 'vegetation') AS n_vegetation, count(*) FILTER (WHERE cover = 'mixed') AS n_mixed, count(*) FILTER (WHERE cover = 'unassessable') AS n_unassessable
  FROM areas WHERE label = 'interrow_area' GROUP BY 1""")
def a10(spark, sf_dir):
    return measures.interrow_groups(areas(spark, sf_dir).where("label = 'interrow_area'"))


@query("a11_waste_groups", f"""WITH {SQL_AREAS} SELECT vineyard_id, count(*) AS n, count(*) FILTER (WHERE area_m2 % 3 = 0) AS on_route FROM areas WHERE label = 'waste' GROUP BY 1""")
def a11(spark, sf_dir):
    waste = areas(spark, sf_dir).where("label = 'waste'")
    return waste.groupBy("vineyard_id").agg(F.count("*").alias("n"), F.count_if(F.col("area_m2") % 3 == 0).alias("on_route")).orderBy(F.col("vineyard_id").asc_nulls_last())


@query("a12_finding_totals", """SELECT CASE WHEN user_id % 6 = 0 THEN NULL ELSE event_type END AS finding, count(*) AS n, min(ts) FILTER (WHERE event_id % 4 <> 0) AS first_reached, max(ts) FILTER (WHERE event_id % 4 <> 0) AS last_reached FROM events GROUP BY 1""")
def a12(spark, sf_dir):
    reached = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    return read(spark, sf_dir, "events").groupBy(F.when(F.col("user_id") % 6 != 0, F.col("event_type")).alias("finding")).agg(F.count("*").alias("n"), F.min(reached).alias("first_reached"), F.max(reached).alias("last_reached"))


@query("a16_merged_lengths", f"WITH {SQL_ROWS} SELECT vineyard_id, row_id, round(row_length_m, 2) AS row_length_m FROM line")
def a16(spark, sf_dir):
    return measures.row_lengths(segments(spark, sf_dir)).select("vineyard_id", "row_id", F.round("row_length_m", 2).alias("row_length_m"))


@query("g01_box_union_area", f"WITH {SQL_CELLS} SELECT label, count(DISTINCT px * 1000 + py) AS area FROM cells GROUP BY 1")
def g01(spark, sf_dir):
    return measures.box_area(areas(spark, sf_dir), ["label"])


SQL_STOPS = """stops AS (SELECT o_custkey AS route_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS stop_order, o_orderkey AS target_id,
  CAST(sum(o_orderkey % 17) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS distance_m, o_orderstatus = 'F' AS reached FROM orders)"""


def routes(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    stops = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("stop_ids"))
    far = F.transform("stop_ids", lambda x: (x % 17).cast("double"))
    upto = F.transform(F.sequence(F.lit(1), F.size("stop_ids")), lambda i: F.aggregate(F.slice(far, 1, i), F.lit(0.0), lambda s, x: s + x))
    return stops.select(F.col("o_custkey").alias("route_id"), "stop_ids", upto.alias("stop_distances_m"))


@query("j04_stops_with_targets", f"""WITH {SQL_STOPS} SELECT route_id, stop_order, target_id, distance_m, o_orderpriority AS kind FROM stops JOIN orders ON o_orderkey = target_id WHERE o_orderpriority <> '5-LOW'""")
def j04(spark, sf_dir):
    targets = read(spark, sf_dir, "orders").where("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("kind"))
    return measures.stops_with_targets(routes(spark, sf_dir), targets)


@query("w04_legs", f"""WITH {SQL_STOPS} SELECT route_id, stop_order, distance_m, distance_m - lag(distance_m, 1, 0) OVER (PARTITION BY route_id ORDER BY stop_order) AS leg_m,
  COALESCE(max(distance_m) FILTER (WHERE reached) OVER (PARTITION BY route_id), 0.0::DOUBLE) AS walked_m, min(stop_order) FILTER (WHERE NOT reached) OVER (PARTITION BY route_id) AS current_stop FROM stops""")
def w04(spark, sf_dir):
    state = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), (F.col("o_orderstatus") == "F").alias("reached"), F.lit("x").alias("kind"))
    stops = measures.stops_with_targets(routes(spark, sf_dir), state)
    return measures.legs(stops.join(state.select("target_id", "reached"), "target_id"))


@query("j05_reachability", """SELECT c.c_custkey AS target_id, COALESCE(n.r, c.c_acctbal > 0) AS reachable FROM customer c LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS r FROM orders WHERE o_totalprice > 100000 GROUP BY 1) n ON n.o_custkey = c.c_custkey""")
def j05(spark, sf_dir):
    new = read(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("new"))
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), (F.col("c_acctbal") > 0).alias("old"))
    return old.join(new, F.col("target_id") == F.col("o_custkey"), "left").select("target_id", F.coalesce("new", "old").alias("reachable"))


@query("j06_waste_on_route", f"""WITH {SQL_STOPS} SELECT c_custkey AS waste_id, min(stop_order) AS stop_order FROM customer LEFT JOIN stops ON target_id = c_custkey GROUP BY 1""")
def j06(spark, sf_dir):
    stops = routes(spark, sf_dir).select(F.posexplode("stop_ids").alias("at", "target_id")).groupBy("target_id").agg((F.min("at") + 1).alias("stop_order"))
    return read(spark, sf_dir, "customer").join(stops, F.col("c_custkey") == F.col("target_id"), "left").select(F.col("c_custkey").alias("waste_id"), "stop_order")


@query("j07_records_of_stops", f"""WITH {SQL_STOPS}, v2 AS (SELECT user_id, min(value) AS note FROM events WHERE event_id % 2 = 0 GROUP BY 1), v1 AS (SELECT user_id, min(value) AS note FROM events WHERE event_id % 2 = 1 GROUP BY 1)
  SELECT route_id, stop_order, target_id, round(COALESCE(v2.note, v1.note), 3) AS note FROM stops LEFT JOIN v2 ON v2.user_id = target_id LEFT JOIN v1 ON v1.user_id = target_id WHERE COALESCE(v2.note, v1.note) IS NOT NULL""")
def j07(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    book = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.min("value").alias(f"note{k}"))
    records = book(0).join(book(1), "user_id", "full").select("user_id", F.round(F.coalesce("note0", "note1"), 3).alias("note"))
    stops = routes(spark, sf_dir).select("route_id", F.posexplode("stop_ids").alias("at", "target_id"))
    return stops.join(records, F.col("target_id") == F.col("user_id")).select("route_id", (F.col("at") + 1).alias("stop_order"), "target_id", "note").where("note is not null")


@query("j08_surveys_of_parcel", """WITH s AS (SELECT o_custkey AS survey, list_distinct(list(o_orderkey % 100)) AS parcels FROM orders GROUP BY 1)
  SELECT survey, list_contains(parcels, 7) AS has_parcel, len(list_intersect(parcels, [1, 2, 3])) = 0 AS outside FROM s""")
def j08(spark, sf_dir):
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("survey")).agg(F.collect_set(F.col("o_orderkey") % 100).alias("parcels"))
    return s.select("survey", F.array_contains("parcels", F.lit(7).cast("long")).alias("has_parcel"), (~F.arrays_overlap("parcels", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]))).alias("outside"))


@query("a14_manifest", """WITH t AS (SELECT p_brand AS label, p_partkey AS id, p_partkey % 50 AS row, p_partkey // 1000 AS part FROM part),
  parts AS (SELECT label, part, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS digest FROM t GROUP BY 1, 2),
  whole AS (SELECT label, sha256(string_agg(digest, ',' ORDER BY part)) AS sha256 FROM parts GROUP BY 1)
  SELECT label, count(*) AS features, count(DISTINCT row) AS physical_rows, any_value(sha256) AS sha256 FROM t JOIN whole USING (label) GROUP BY 1""")
def a14(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("row"))
    return measures.manifest(t, 1000)


@query("a22_coverage", """SELECT c_nationkey AS survey, count(*) AS targets, count(*) FILTER (WHERE c_acctbal > 3000) AS visited, round(count(*) FILTER (WHERE c_acctbal > 3000) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM customer GROUP BY 1""")
def a22(spark, sf_dir):
    n, seen = F.count("*"), F.count_if(F.col("c_acctbal") > 3000)
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("survey")).agg(n.alias("targets"), seen.alias("visited"), F.when(n > 0, F.round(seen / n, 6)).alias("coverage"))
