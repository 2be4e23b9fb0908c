"""Queries of presence and locks, as tables."""

from pyspark.sql import functions as F

from ..streaming import presence
from .inputs import read
from .registry import query

SQL_EVENTS = "ev AS (SELECT event_id, 'u' || user_id AS client, event_id % 40 AS tile, CAST(epoch(ts) AS DOUBLE) AS at_s, event_type FROM events)"


def events(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "heartbeat", "click", "claim", "purchase", "release", "signup", "heartbeat", "error", "force_release")])
    t = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return t.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), (F.col("event_id") % 40).alias("tile"), (F.unix_micros("ts") / 1e6).alias("at"), kinds[F.col("event_type")].alias("kind"), "ts")


@query("st01_locks", f"""WITH RECURSIVE {SQL_EVENTS}, k AS (SELECT *, map {{'view': 'heartbeat', 'click': 'claim', 'purchase': 'release', 'signup': 'heartbeat', 'error': 'force_release'}}[event_type] AS kind,
    row_number() OVER (PARTITION BY tile ORDER BY at_s, event_id) AS n FROM ev),
  f AS (SELECT tile, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, false AS accepted, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS DOUBLE) AS since FROM (SELECT DISTINCT tile FROM k)
    UNION ALL SELECT tile, n, event_id, CASE WHEN kind IN ('claim', 'heartbeat') THEN held IS NULL OR held = client WHEN kind = 'release' THEN coalesce(held = client, false) ELSE held IS NOT NULL END,
      CASE WHEN kind IN ('claim', 'heartbeat') THEN coalesce(held, client) WHEN kind = 'release' AND held <> client THEN held END,
      CASE WHEN kind IN ('claim', 'heartbeat') AND coalesce(held, client) = client THEN at_s ELSE since END
    FROM (SELECT k.*, f.since, CASE WHEN k.at_s - f.since <= 3600 THEN f.holder END AS held FROM f JOIN k ON k.tile = f.tile AND k.n = f.n + 1))
  SELECT tile, event_id, accepted, holder FROM f WHERE n > 0""")
def st01(spark, sf_dir):
    return presence.lock_history(events(spark, sf_dir), 3600.0)


@query("st02_sessions", f"""WITH {SQL_EVENTS}, g AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER w > 14400 THEN 1 ELSE 0 END AS s FROM ev WINDOW w AS (PARTITION BY client ORDER BY at_s, event_id)),
  r AS (SELECT *, sum(s) OVER (PARTITION BY client ORDER BY at_s, event_id) AS run FROM g) SELECT client, min(at_s) AS first, max(at_s) AS last, count(*) AS n FROM r GROUP BY client, run""")
def st02(spark, sf_dir):
    return presence.sessions(events(spark, sf_dir), 14_400)


@query("st03_snapshot", f"""WITH {SQL_EVENTS}, n AS (SELECT max(at_s) AS t FROM ev), l AS (SELECT client, max({{'a': at_s, 'b': event_id, 'c': tile}}) AS l FROM ev GROUP BY 1)
  SELECT client, l.c AS tile, round(t - l.a, 3) AS idle_secs FROM l, n WHERE t - l.a <= 86400""")
def st03(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg(F.max("at")).first()[0]  # one number
    return presence.snapshot(e, F.lit(now), 86_400)


@query("st06_coalesced_saves", """WITH c AS (SELECT user_id AS doc, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  r AS (SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY ts) AS run FROM c) SELECT doc, CAST(epoch_us(max(ts) + INTERVAL 2 HOUR) AS BIGINT) AS saved_us, count(*) AS n FROM r GROUP BY doc, run""")
def st06(spark, sf_dir):
    t = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("ts").cast("timestamp").alias("ts"))
    return presence.coalesced_saves(t, "2 hours").select("doc", F.unix_micros("saved_at").alias("saved_us"), "n")


@query("st05_processing_states", """SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'uploading' ELSE 'processing' END AS state, event_type IN ('error', 'purchase') AS settled FROM events""")
def st05(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "signup", "uploading").otherwise("processing")
    return read(spark, sf_dir, "events").select("event_id", state.alias("state")).withColumn("settled", F.col("state").isin("failed", "ready"))
