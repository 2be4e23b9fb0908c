"""Queries of the label store."""

from pyspark.sql import functions as F

from ..operators import labels
from .inputs import SQL_ANNOTATIONS, SQL_STATUSES, SQL_TILE, SQL_TILES, annotations, read, statuses, tile_name, tiles
from .registry import query

SQL_LOCKS = f"""locks AS (SELECT {SQL_TILE.format('event_id % 40')} AS tile_name, arg_max('u' || user_id % 25, {{'a': ts, 'b': 'u' || user_id % 25}}) AS locked_by FROM events WHERE event_type = 'click' GROUP BY 1)"""
SQL_BOARD = f"""WITH {SQL_TILES}, {SQL_STATUSES}, {SQL_ANNOTATIONS}, {SQL_LOCKS}, board AS (
  SELECT t.name, COALESCE(s.verification_status, 'unchecked') AS status, COALESCE(c.n, 0) AS n_labels, s.updated_by, l.locked_by
  FROM tiles t LEFT JOIN statuses s USING (name) LEFT JOIN (SELECT tile_name, count(*) AS n FROM annotations GROUP BY 1) c ON c.tile_name = t.name
  LEFT JOIN locks l ON l.tile_name = t.name)"""


def locks(spark, sf_dir):
    client = F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string"))
    return labels.latest_locks(read(spark, sf_dir, "events").where("event_type = 'click'").select(tile_name(F.col("event_id") % 40).alias("tile_name"), F.col("ts").alias("at"), client.alias("client")))


def board(spark, sf_dir):
    return labels.tile_board(tiles(spark, sf_dir), statuses(spark, sf_dir), annotations(spark, sf_dir), locks(spark, sf_dir))


@query("j01_tile_board", f"{SQL_BOARD} SELECT * FROM board")
def j01(spark, sf_dir):
    return board(spark, sf_dir)


@query("sc01_tile_listing", f"WITH {SQL_TILES} SELECT name FROM tiles WHERE regexp_matches(name, '^tile_r[0-9]{{3}}_c[0-9]{{3}}$') ORDER BY name")
def sc01(spark, sf_dir):
    return tiles(spark, sf_dir).where(F.col("name").rlike(r"^tile_r\d{3}_c\d{3}$")).select("name").orderBy("name")


@query("p01_tiles_with_status", f"WITH {SQL_STATUSES} SELECT name FROM statuses WHERE verification_status = 'verified'")
def p01(spark, sf_dir):
    return statuses(spark, sf_dir).where("verification_status = 'verified'").select("name")


@query("p02_exported_tiles", f"""WITH {SQL_TILES}, {SQL_STATUSES}, {SQL_ANNOTATIONS}, invalid AS (SELECT name FROM statuses WHERE verification_status = 'invalid'),
  chosen AS (SELECT tile_name AS name FROM annotations UNION SELECT name FROM invalid)
  SELECT c.name, COALESCE(l.n_labels, 0) AS n_labels, l.last_id FROM chosen c SEMI JOIN tiles t ON t.name = c.name LEFT JOIN (
    SELECT tile_name, count(*) AS n_labels, max(id) AS last_id FROM annotations WHERE tile_name NOT IN (SELECT name FROM invalid) GROUP BY 1) l ON l.tile_name = c.name""")
def p02(spark, sf_dir):
    return labels.exported(tiles(spark, sf_dir), statuses(spark, sf_dir), annotations(spark, sf_dir))


@query("p03_work_queue", f"""{SQL_BOARD} SELECT name, status = 'verified' AS done, status = 'invalid' AS invalid,
  COALESCE(locked_by = 'u7', FALSE) OR (status = 'in_progress' AND COALESCE(updated_by = 'u7', FALSE)) AS mine,
  status NOT IN ('verified', 'invalid') AND COALESCE(locked_by = 'u7', TRUE) AS queue FROM board""")
def p03(spark, sf_dir):
    return labels.in_view(board(spark, sf_dir), "u7")


@query("p04_enough_points", f"""WITH {SQL_ANNOTATIONS} SELECT shape_type, count(*) AS n, CAST(sum(n_points) AS BIGINT) AS points FROM annotations
  WHERE n_points >= CASE WHEN shape_type = 'polygon' THEN 3 ELSE 2 END GROUP BY 1""")
def p04(spark, sf_dir):
    return labels.enough_points(annotations(spark, sf_dir)).groupBy("shape_type").agg(F.count("*").alias("n"), F.sum("n_points").alias("points"))


@query("a01_labels_per_tile", f"WITH {SQL_ANNOTATIONS} SELECT tile_name, count(*) AS n FROM annotations GROUP BY 1")
def a01(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("tile_name").agg(F.count("*").alias("n"))


@query("a02_status_counts", f"{SQL_BOARD} SELECT s.status, count(b.name) AS n FROM (SELECT unnest(['unchecked', 'in_progress', 'verified', 'invalid']) AS status) s LEFT JOIN board b USING (status) GROUP BY 1")
def a02(spark, sf_dir):
    return labels.status_counts(board(spark, sf_dir))


@query("a03_progress", f"{SQL_BOARD} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'verified') / count(*), 2) AS percent FROM board")
def a03(spark, sf_dir):
    return labels.progress(board(spark, sf_dir))


@query("a04_annotated_tiles", f"WITH {SQL_ANNOTATIONS} SELECT DISTINCT tile_name FROM annotations ORDER BY 1")
def a04(spark, sf_dir):
    return annotations(spark, sf_dir).select("tile_name").distinct().orderBy("tile_name")


@query("a25_view_counts", f"""{SQL_BOARD} SELECT count(*) FILTER (WHERE status = 'verified') AS done, count(*) FILTER (WHERE status = 'invalid') AS invalid,
  count(*) FILTER (WHERE status NOT IN ('verified', 'invalid') AND COALESCE(locked_by = 'u7', TRUE)) AS queue FROM board""")
def a25(spark, sf_dir):
    return labels.in_view(board(spark, sf_dir), "u7").agg(F.count_if("done").alias("done"), F.count_if("invalid").alias("invalid"), F.count_if("queue").alias("queue"))


@query("t04_sorted_tiles", f"{SQL_BOARD} SELECT name, status, CAST(row_number() OVER (ORDER BY list_position(['in_progress', 'unchecked', 'verified', 'invalid'], status), name) AS INTEGER) AS place FROM board")
def t04(spark, sf_dir):
    return labels.sorted_tiles(board(spark, sf_dir), by_status=True)


@query("so02_insert_missing", f"""WITH {SQL_TILES}, {SQL_STATUSES} SELECT name, verification_status, updated_by FROM statuses
  UNION ALL SELECT name, 'unchecked', NULL FROM tiles WHERE name NOT IN (SELECT name FROM statuses)""")
def so02(spark, sf_dir):
    new = tiles(spark, sf_dir).select("name", F.lit("unchecked").alias("verification_status"), F.lit(None).cast("string").alias("updated_by"))
    return labels.insert_missing(statuses(spark, sf_dir), new, "name")


@query("so03_replace_tiles", f"""WITH {SQL_ANNOTATIONS}, new AS (SELECT id + 1000000000 AS id, tile_name, 'row' AS label FROM annotations WHERE tile_name LIKE '%\\_c003' ESCAPE '\\' AND label = 'waste')
  SELECT tile_name, label, count(*) AS n, max(id) AS last_id FROM (SELECT id, tile_name, label FROM annotations WHERE tile_name NOT IN (SELECT tile_name FROM new) UNION ALL SELECT * FROM new) GROUP BY 1, 2""")
def so03(spark, sf_dir):
    a = annotations(spark, sf_dir).select("id", "tile_name", "label")
    new = a.where(F.col("tile_name").endswith("_c003") & (F.col("label") == "waste")).select((F.col("id") + 1_000_000_000).alias("id"), "tile_name", F.lit("row").alias("label"))
    return labels.replace_partition(a, new, "tile_name").groupBy("tile_name", "label").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("so04_patch", """SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 AND c_acctbal < 0 THEN 'waste' ELSE c_mktsegment END AS label,
  CASE WHEN c_nationkey < 5 THEN c_nationkey + 10 ELSE c_nationkey END AS z_order FROM customer WHERE c_acctbal <= 9000""")
def so04(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("z_order"), "c_acctbal")
    changes = a.where("z_order < 5").select("id", F.when(F.col("c_acctbal") < 0, "waste").alias("label"), (F.col("z_order") + 10).alias("z_order"))
    return labels.patch(a.drop("c_acctbal"), changes, a.where("c_acctbal > 9000").select("id"), "id")


PROMPTS = {"vines": "vineyard", "rubbish": "waste", "lane": "interrow_area"}
SUFFIXES = {"labels": "vineyard", "rows": "row", "trash": "waste"}
SQL_FEATURES = """features AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 4 = 0 THEN ' row ' WHEN l_partkey % 4 = 1 THEN '  ' END AS label,
  CASE l_suppkey % 5 WHEN 0 THEN ' Vines' WHEN 1 THEN 'RUBBISH' WHEN 2 THEN 'other' END AS prompt,
  'tile' || l_suppkey % 23 || CASE l_linenumber % 4 WHEN 0 THEN '__labels' WHEN 1 THEN '__Trash' WHEN 2 THEN '__x__y' ELSE '' END AS base FROM lineitem)"""


def features(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    pick = lambda n, k, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % k + 1).cast("int"))
    base = F.concat(F.lit("tile"), (F.col("l_suppkey") % 23).cast("string"), pick(F.col("l_linenumber"), 4, ("__labels", "__Trash", "__x__y", "")))
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), pick(F.col("l_partkey"), 4, (" row ", "  ", None, None)).alias("label"), pick(F.col("l_suppkey"), 5, (" Vines", "RUBBISH", "other", None, None)).alias("prompt"), base.alias("base"))


@query("pr04_derived_labels", f"""WITH {SQL_FEATURES}, named AS (SELECT id, split_part(base, '__', 1) AS tile, label, prompt, CASE WHEN contains(base, '__') THEN regexp_replace(base, '^.*?__', '') END AS suffix FROM features)
  SELECT COALESCE(NULLIF(trim(label), ''), CASE lower(trim(prompt)) WHEN 'vines' THEN 'vineyard' WHEN 'rubbish' THEN 'waste' WHEN 'lane' THEN 'interrow_area' END,
    CASE lower(suffix) WHEN 'labels' THEN 'vineyard' WHEN 'rows' THEN 'row' WHEN 'trash' THEN 'waste' END) AS label, count(*) AS n, count(DISTINCT tile) AS n_tiles FROM named GROUP BY 1""")
def pr04(spark, sf_dir):
    parts = F.split("base", "__", 2)
    named = features(spark, sf_dir).select("id", parts[0].alias("tile"), labels.derived_label(F.col("label"), F.col("prompt"), F.get(parts, F.lit(1)), PROMPTS, SUFFIXES).alias("label"))
    return labels.import_summary(named)


@query("j02_label_files", f"""WITH {SQL_FEATURES}, named AS (SELECT split_part(base, '__', 1) AS tile FROM features), rasters AS (SELECT DISTINCT 'tile' || s_suppkey % 19 AS tile FROM supplier)
  SELECT n.tile, r.tile IS NOT NULL AS has_raster, count(*) AS n FROM named n LEFT JOIN rasters r USING (tile) GROUP BY 1, 2""")
def j02(spark, sf_dir):
    rasters = read(spark, sf_dir, "supplier").select(F.concat(F.lit("tile"), (F.col("s_suppkey") % 19).cast("string")).alias("tile")).distinct().withColumn("has", F.lit(True))
    named = features(spark, sf_dir).select(F.split("base", "__", 2)[0].alias("tile"))
    return named.join(rasters, "tile", "left").groupBy("tile", F.col("has").isNotNull().alias("has_raster")).agg(F.count("*").alias("n"))


@query("sk04_export_parts", f"""WITH RECURSIVE {SQL_TILES}, n AS (SELECT *, row_number() OVER (ORDER BY name, size_bytes) AS k FROM tiles),
  f AS (SELECT name, size_bytes, k, 1 AS part, size_bytes AS held FROM n WHERE k = 1
    UNION ALL SELECT n.name, n.size_bytes, n.k, CASE WHEN f.held + n.size_bytes > 90000000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.held + n.size_bytes > 90000000 THEN n.size_bytes ELSE f.held + n.size_bytes END FROM f JOIN n ON n.k = f.k + 1)
  SELECT name, size_bytes, CAST(part AS INTEGER) AS part FROM f""")
def sk04(spark, sf_dir):
    return labels.next_fit(tiles(spark, sf_dir), 90_000_000)


@query("w10_priority_overlay", f"""WITH {SQL_ANNOTATIONS}, pixels AS (SELECT tile_name, id, z_order, label, x + i AS px, y + j AS py
    FROM (SELECT *, unnest(range(w)) AS i FROM annotations), (SELECT unnest(range(7)) AS j) WHERE j < h AND label <> 'dead_vine'),
  ranked AS (SELECT tile_name, px, py, label, row_number() OVER (PARTITION BY tile_name, px, py ORDER BY list_position(['vineyard', 'interrow_area', 'waste', 'row'], label) DESC, id DESC) AS k FROM pixels)
  SELECT tile_name, label, count(*) AS pixels, CAST(sum(px * 1000 + py) AS BIGINT) AS places FROM ranked WHERE k = 1 GROUP BY 1, 2""")
def w10(spark, sf_dir):
    from ..operators.raster import burnt_runs, rank_of
    from ..sources.shared import spread

    # shapes are dealt by bands of 16 lines of a tile, and cut into lines there
    band, y, last = F.col("band") * 16, F.col("y"), F.col("y") + F.col("h") - 1
    a = annotations(spark, sf_dir).where(rank_of("label").isNotNull()).select("tile_name", "x", "w", "y", "h", "label", "id", F.explode(F.sequence(F.floor(y / 16), F.floor(last / 16))).alias("band"))
    a = spread(a, "tile_name", "band").sortWithinPartitions("tile_name", "band")
    runs = a.select("tile_name", "band", F.explode(F.sequence(F.greatest(y, band), F.least(last, band + 15))).alias("py"), F.col("x").alias("start"), (F.col("x") + F.col("w")).alias("end"), "label", "id")
    n = F.col("end") - F.col("start")
    places = (F.col("start") + F.col("end") - 1) * n / 2 * 1000 + F.col("py") * n
    return burnt_runs(runs, ["tile_name", "band"], "py", "id", dealt=True).groupBy("tile_name", "label").agg(F.sum(n).alias("pixels"), F.sum(places.cast("long")).alias("places"))
