"""``events`` as a stream; each query drains what is available and returns it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspan.operators.store import Store
from larkspan.plans.registry import query
from larkspan.session import scratch_root, table
from larkspan.streaming import events as st, indexer, timers


def _stream(spark, d):
    return st.parquet_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS calls FROM events GROUP BY ALL")
def stream_hourly_counts(spark, d):
    return st.run_available(st.hourly_counts(_stream(spark, d), "ts", ["event_type"]), "complete", "hourly")


@query("stream_bursts", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, min(ts) AS first_at, count(*) AS events, count(DISTINCT event_type) AS items, count(DISTINCT event_type) > 3 AS full_scan FROM b GROUP BY user_id, burst""")
def stream_bursts(spark, d):
    return st.run_available(st.bursts(_stream(spark, d), "ts", ["user_id"], F.col("event_type"), "1 hour", 3), "complete", "bursts")


@query("stream_breaker", """
WITH r AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER w AS busy_count, event_type = 'error' AND sum((event_type = 'error')::INT) OVER w >= 3 AS opens FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)""")
def stream_breaker(spark, d):
    e = _stream(spark, d)
    outcome = F.when(F.col("event_type") == "error", "busy").when(F.col("event_type") == "purchase", "ok").otherwise("other")
    return st.run_available(st.breaker(e.withColumn("outcome", outcome), "user_id", "ts", "event_id", "outcome"), "append", "breaker")


@query("stream_alerts", """
WITH RECURSIVE a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
s(user_id, x) AS (
  SELECT user_id, min({'ts': ts, 'event_id': event_id}) FROM a GROUP BY user_id
  UNION ALL
  SELECT a.user_id, min({'ts': a.ts, 'event_id': a.event_id}) FROM s JOIN a ON a.user_id = s.user_id AND a.ts >= s.x.ts + INTERVAL 1 DAY GROUP BY a.user_id)
SELECT user_id, x.event_id AS event_id FROM s""")
def stream_alerts(spark, d):
    return st.run_available(st.once_a_day(_stream(spark, d).where("event_type = 'error'"), "user_id", "ts", "event_id"), "append", "alerts")


@query("stream_breaker_idle", """
WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 AS quiet FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum((event_type = 'purchase' OR coalesce(quiet, false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
c AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r)
SELECT user_id, event_id, n::BIGINT AS busy_count, event_type = 'error' AND n >= 2 AS opens FROM c""")
def stream_breaker_idle(spark, d):
    """The breaker of users, forgotten after two quiet hours."""
    outcome = F.when(F.col("event_type") == "error", "busy").when(F.col("event_type") == "purchase", "ok").otherwise("other")
    e = _stream(spark, d).withColumn("outcome", outcome)
    return st.run_available(timers.breaker(e, "user_id", "ts", "event_id", "outcome", trip=2, idle=7200), "append", "idle")


@query("stream_muted_alerts", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'signup')),
s AS (
  SELECT user_id, event_id, i, event_type = 'error' AS sent, ts + CASE event_type WHEN 'error' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END AS until FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, e.event_type = 'error' AND e.ts >= s.until,
         CASE WHEN e.event_type = 'signup' THEN greatest(s.until, e.ts + INTERVAL 7 DAY) WHEN e.ts >= s.until THEN e.ts + INTERVAL 1 DAY ELSE s.until END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id FROM s WHERE sent""")
def stream_muted_alerts(spark, d):
    """Errors alert once a day for a user, and not for a week after a signup."""
    kind = F.when(F.col("event_type") == "error", "alert").when(F.col("event_type") == "signup", "mute").otherwise("other")
    return st.run_available(timers.alerts(_stream(spark, d).withColumn("kind", kind), "user_id", "ts", "event_id", "kind"), "append", "muted")


@query("stream_requests", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('view', 'click', 'purchase')),
s AS (
  SELECT user_id, event_id, event_type, i, CASE WHEN event_type <> 'purchase' THEN event_id END AS work, CASE WHEN event_type <> 'purchase' THEN ts + INTERVAL 1 HOUR END AS until, NULL::BIGINT AS joins FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.event_type, e.i,
         CASE WHEN e.event_type = 'purchase' THEN NULL WHEN e.ts < s.until THEN s.work ELSE e.event_id END,
         CASE WHEN e.event_type = 'purchase' THEN NULL WHEN e.ts < s.until THEN s.until ELSE e.ts + INTERVAL 1 HOUR END,
         CASE WHEN e.event_type <> 'purchase' AND e.ts < s.until THEN s.work END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, joins FROM s WHERE event_type <> 'purchase'""")
def stream_requests(spark, d):
    """Views and clicks of a user join the request under way, for an hour at most or until a purchase."""
    kind = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type") == "purchase", "done").otherwise("other")
    return st.run_available(timers.requests(_stream(spark, d).withColumn("kind", kind), "user_id", "ts", "event_id", "kind", most=3600), "append", "requests")


@query("stream_adaptive_jobs")
def stream_adaptive_jobs(spark, d):
    return st.run_available(st.adaptive_jobs(_stream(spark, d), "event_type", "ts", "event_id"), "append", "jobs")


@query("stream_in_flight", "SELECT DISTINCT user_id, event_type FROM events")
def stream_in_flight(spark, d):
    return st.run_available(st.in_flight(_stream(spark, d), ["user_id", "event_type"], "ts", "10 days").select("user_id", "event_type"), "append", "inflight")


def _indexed(spark, d):
    """A store into which the turns of ``conversations`` went as changes: each turn rewrites its conversation, a user's takes it out."""
    where = f"{scratch_root(spark)}/larkspan/{spark.sparkContext.applicationId}/indexer-{uuid.uuid4().hex}"
    turns = st.parquet_stream(spark, f"{d}/conversations.parquet")
    changes = turns.select(F.col("conv_id").cast("string").alias("path"), "text", (F.col("role") == "user").alias("deleted"), "turn")
    store = Store(spark, f"{where}/store")
    indexer.index_stream(changes, store, F.struct("turn", F.coalesce("text", F.lit(""))), f"{where}/state", "conversations", buckets=8).awaitTermination()
    return store


_LAST_TURNS = """
WITH l AS (SELECT conv_id::VARCHAR AS path, unnest(max({'turn': turn, 'text': coalesce(text, ''), 'role': role})) FROM conversations GROUP BY conv_id),
f AS (SELECT path, text FROM l WHERE role <> 'user')"""


@query("stream_index_files", _LAST_TURNS + "SELECT path, sha256(text) AS digest, strlen(text) AS size FROM f")
def stream_index_files(spark, d):
    """The manifest that the incremental indexer commits."""
    return indexer.live_files(_indexed(spark, d)).select("path", "digest", F.col("size").cast("long").alias("size"))


@query("stream_index_terms", _LAST_TURNS + """,
t AS (SELECT path, unnest(list_distinct(list_concat(regexp_extract_all(lower(path), '[\\p{L}\\p{N}]+'),
                                                  regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')))) AS term FROM f WHERE text <> '')
SELECT term, count(*) AS n FROM t GROUP BY term""")
def stream_index_terms(spark, d):
    """The document frequencies of the index that the same commit makes visible; conversations are single chunks here."""
    store = _indexed(spark, d)
    return store.read("terms").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")


@query("lease_claims", """
WITH q AS (SELECT o_orderkey AS id, o_orderdate AS updated_at, (o_orderkey % 40 + 1) AS size, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'leased' ELSE 'done' END AS status, o_orderkey % 3 AS attempts FROM orders),
f AS (SELECT *, status = 'pending' OR (status = 'leased' AND id % 2 = 0) AS free FROM q),
u AS (SELECT *, sum(size) OVER (PARTITION BY free AND attempts < 2 ORDER BY updated_at, id) AS used FROM f)
SELECT id, CASE WHEN free AND attempts >= 2 THEN 'failed' WHEN free AND used <= 500 THEN 'leased' ELSE status END AS status, (attempts + (free AND attempts < 2 AND used <= 500)::INT)::BIGINT AS attempts FROM u""")
def lease_claims(spark, d):
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    q = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 40 + 1).alias("size"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "leased").otherwise("done").alias("status"), (F.col("o_orderkey") % 3).alias("attempts"),
        F.when(F.col("o_orderkey") % 2 == 0, F.to_timestamp(F.lit("2024-05-31 00:00:00"))).otherwise(F.to_timestamp(F.lit("2024-06-02 00:00:00"))).alias("lease_until"),
    )
    return st.claim(q, now, 500).select("id", "status", "attempts")


@query("dirty_flags", """
WITH f AS (SELECT user_id AS id, event_id AS seq FROM events WHERE event_type = 'click'), j AS (SELECT user_id AS id, max(event_id) AS m FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT f.id, f.seq FROM f LEFT JOIN j USING (id) WHERE m IS NULL OR seq > m""")
def dirty_flags(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    return st.clear_flags(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"))
