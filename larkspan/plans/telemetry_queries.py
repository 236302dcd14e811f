"""Telemetry over ``events``: event_type is the purpose, user_id the session, value the elapsed time."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import telemetry as tm
from larkspan.plans.registry import query
from larkspan.session import table


def _events(spark, d):
    return table(spark, d, "events")


def _failed():
    return F.col("event_type") == "error"


@query("usage_rollup", """
SELECT event_type, count(*) AS calls, sum(value) FILTER (WHERE value > 50) AS reported_value, count(DISTINCT user_id) AS users
FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def usage_rollup(spark, d):
    return tm.usage_rollup(_events(spark, d), ["event_type"], {
        "calls": F.count("*"), "reported_value": tm.nullable_sum(F.col("value"), F.col("value") > 50), "users": F.countDistinct("user_id"),
    })


@query("usage_detail", """
SELECT user_id % 10 AS project, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, sum(value) AS total
FROM events GROUP BY ROLLUP (user_id % 10, event_type, strftime(ts, '%Y-%m-%d'))""")
def usage_detail(spark, d):
    e = _events(spark, d).select((F.col("user_id") % 10).alias("project"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return e.rollup("project", "event_type", "day").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))


_P99 = """
WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS calls FROM events GROUP BY ALL),
b AS (SELECT a.event_type, a.hour, a.calls, quantile_disc(p.calls, 0.99) AS p99
      FROM h a LEFT JOIN h p ON p.event_type = a.event_type AND p.hour BETWEEN a.hour - 168 AND a.hour - 1 GROUP BY a.event_type, a.hour, a.calls)
SELECT event_type, hour, calls, p99, greatest({floor}.0::DOUBLE, {factor} * coalesce(p99, 0)) AS threshold,
       calls > greatest({floor}.0::DOUBLE, {factor} * coalesce(p99, 0)) AS alert FROM b"""


@query("volume_p99_alert", _P99.format(floor=100, factor=2))
def volume_p99_alert(spark, d):
    return tm.volume_alerts(_events(spark, d), "ts", ["event_type"])


@query("volume_p99_alert_low", _P99.format(floor=3, factor=1))
def volume_p99_alert_low(spark, d):
    return tm.volume_alerts(_events(spark, d), "ts", ["event_type"], floor=3, factor=1)


@query("calls_in_order", """
SELECT event_type, count(*) AS calls, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS place
FROM events WHERE event_type IN ('purchase', 'view', 'signup') GROUP BY event_type""")
def calls_in_order(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("purchase", "view", "signup", "absent")])
    e = _events(spark, d).where(F.array_contains(wanted, F.col("event_type")))
    return e.groupBy("event_type").agg(F.count("*").alias("calls")).withColumn("place", F.array_position(wanted, F.col("event_type")).cast("int"))


@query("last20_success_rate", """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
           FROM events WHERE event_type <> 'signup')
SELECT user_id, avg((event_type <> 'error')::INT) FILTER (WHERE k <= 20) AS rate, count(k) FILTER (WHERE k <= 20) AS counted
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN r USING (user_id) GROUP BY user_id""")
def last20_success_rate(spark, d):
    return tm.last_n_rate(_events(spark, d), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], ~_failed(), F.col("event_type") != "signup")


@query("next_event_outcome", """
WITH n AS (SELECT event_type, ts, lead(event_type) OVER w AS nx, lead(ts) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type, coalesce(CASE WHEN epoch_us(nt) - epoch_us(ts) <= 900000000 THEN nx END, 'no_other_call') AS outcome, count(*) AS n FROM n GROUP BY ALL""")
def next_event_outcome(spark, d):
    e = tm.next_event(_events(spark, d), "user_id", "ts", "event_id", carry=("event_type",))
    return e.groupBy("event_type", F.coalesce("next_event_type", F.lit("no_other_call")).alias("outcome")).agg(F.count("*").alias("n"))


@query("reason_shapes", """
SELECT regexp_replace(props, '\\d+', 'N', 'g') AS reason, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, reason, event_type LIMIT 8""")
def reason_shapes(spark, d):
    e = _events(spark, d).groupBy(tm.reason_shape(F.col("props")).alias("reason"), "event_type").agg(F.count("*").alias("n"))
    return e.orderBy(F.col("n").desc(), "reason", "event_type").limit(8)


_ERROR = """CASE CAST(json_extract_string(props, '$.k') AS INT) % 7 WHEN 0 THEN 'HTTP 429 too many' WHEN 1 THEN 'HTTP Error 503 busy' WHEN 2 THEN 'HTTP 401 who'
  WHEN 3 THEN 'HTTP 500' WHEN 4 THEN 'request timed out' WHEN 5 THEN 'connection refused' ELSE 'odd failure' END"""
_CLASS = """CASE CAST(json_extract_string(props, '$.k') AS INT) % 7 WHEN 0 THEN '429' WHEN 1 THEN '503' WHEN 2 THEN 'auth'
  WHEN 3 THEN '5xx' WHEN 4 THEN 'timeout' WHEN 5 THEN 'connection' ELSE 'other' END"""


def _with_error(e):
    k = F.get_json_object("props", "$.k").cast("int") % 7
    texts = ("HTTP 429 too many", "HTTP Error 503 busy", "HTTP 401 who", "HTTP 500", "request timed out", "connection refused", "odd failure")
    return e.withColumn("error", F.get(F.array(*[F.lit(t) for t in texts]), k))


@query("failure_groups", f"""
WITH f AS (SELECT *, {_ERROR} AS error, {_CLASS} AS class FROM events WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ts DESC, event_id DESC) AS k FROM f)
SELECT class, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, min(error) FILTER (WHERE k = 1) AS sample,
  list(event_id ORDER BY k) FILTER (WHERE k <= 3) AS newest FROM r GROUP BY class""")
def failure_groups(spark, d):
    f = _with_error(_events(spark, d).where(_failed()))
    return tm.failure_groups(f.withColumn("class", tm.failure_class(F.col("error"))), ["class"], "ts", "event_id", "error")


@query("failure_rates", f"""
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, arg_max({_ERROR}, ts) FILTER (WHERE event_type = 'error') AS last_error,
  round_even(count(*) FILTER (WHERE event_type = 'error') / count(*), 3) AS rate,
  count(*) >= 5 AND count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.5 AS failing FROM events GROUP BY user_id""")
def failure_rates(spark, d):
    return tm.failure_rates(_with_error(_events(spark, d)), ["user_id"], "ts", _failed(), F.col("error"))


@query("requester_summary", """
SELECT user_id % 5 AS client, count(DISTINCT user_id) AS sessions, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed,
  max(ts) AS last_at, list_sort(list(DISTINCT event_type)) AS sources FROM events GROUP BY 1""")
def requester_summary(spark, d):
    e = _events(spark, d).withColumn("client", F.col("user_id") % 5)
    return tm.requester_summary(e, ["client"], "user_id", _failed(), "ts", "event_type")


@query("event_pivot", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup,
  count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY user_id""")
def event_pivot(spark, d):
    return _events(spark, d).groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().fillna(0)


@query("cache_stats", """
SELECT count(*) FILTER (WHERE event_type = 'view') / count(*) AS reuse_rate, count(*) FILTER (WHERE event_type = 'error') AS errors,
  avg(value) FILTER (WHERE event_type = 'view') AS hit_elapsed, avg(value) FILTER (WHERE event_type <> 'view') AS miss_elapsed FROM events""")
def cache_stats(spark, d):
    hit = F.col("event_type") == "view"
    return _events(spark, d).agg(
        (F.sum(hit.cast("int")) / F.count("*")).alias("reuse_rate"), F.sum(_failed().cast("int")).alias("errors"),
        F.avg(F.when(hit, F.col("value"))).alias("hit_elapsed"), F.avg(F.when(~hit, F.col("value"))).alias("miss_elapsed"),
    )


@query("retention", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT event_type, event_id FROM r WHERE k <= 50""")
def retention(spark, d):
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return tm.retain(_events(spark, d), "ts", now, days=10, newest=50, by=("event_type",), tie="event_id").select("event_type", "event_id")


@query("recent_records", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def recent_records(spark, d):
    return _events(spark, d).select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(2000)


@query("trailing_hour_rate", """
SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events""")
def trailing_hour_rate(spark, d):
    e = tm.trailing_rate(_events(spark, d), ["event_type"], "ts")
    return e.select("event_id", "in_window", (F.col("in_window") <= 3).alias("allowed"))


@query("breaker_states", """
WITH r AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
b AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS busy_count FROM r)
SELECT event_id, busy_count, event_type = 'error' AND busy_count >= 3 AS opens,
  CASE WHEN event_type = 'error' AND busy_count >= 3 THEN ts + INTERVAL 30 SECOND END AS open_until FROM b""")
def breaker_states(spark, d):
    out = tm.breaker_states(_events(spark, d), ["user_id"], "ts", "event_id", _failed(), F.col("event_type") == "purchase")
    return out.select("event_id", "busy_count", "opens", "open_until")


@query("session_debounce", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, burst, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events, count(DISTINCT event_type) AS items,
  count(DISTINCT event_type) > 3 AS full_scan FROM b GROUP BY user_id, burst""")
def session_debounce(spark, d):
    return tm.debounce(_events(spark, d), ["user_id"], "ts", "event_id", F.col("event_type"), quiet=3600, overflow=3)


@query("token_estimate", """
SELECT role, count(*) AS turns, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM conversations GROUP BY role""")
def token_estimate(spark, d):
    from larkspan.functions.text import token_estimate as estimate

    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(estimate(F.col("text"))).alias("tokens"))


@query("job_progress", """
SELECT o_orderkey, CASE WHEN n > 0 THEN (100 * least(done, n)) // n END AS percent, CASE WHEN done > 0 THEN ceil(greatest(n - done, 0) * secs / done)::BIGINT END AS eta
FROM (SELECT o_orderkey, o_orderkey % 40 AS done, o_orderkey % 35 AS n, (o_custkey % 500)::DOUBLE AS secs FROM orders)""")
def job_progress(spark, d):
    jobs = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("done"), (F.col("o_orderkey") % 35).alias("n"), (F.col("o_custkey") % 500).cast("double").alias("secs"))
    return tm.progress(jobs, "done", "n", "secs").select("o_orderkey", "percent", "eta")


@query("coalesced_writes", """
WITH t AS (SELECT user_id, ts, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events),
g AS (SELECT *, coalesce(s - lag(s) OVER w >= 86400, true) AS f FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g), b AS (SELECT *, min(s) OVER (PARTITION BY user_id, run) AS z FROM r),
k AS (SELECT *, CASE WHEN f THEN 0 ELSE floor((s - z) / 86400) + 1 END AS k FROM b)
SELECT user_id, floor(min(z) + k * 86400)::BIGINT AS "at", k = 0 AS first, count(*) AS events FROM k GROUP BY user_id, run, k""")
def coalesced_writes(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tm.coalesced_writes(e, ["user_id"], "ts", "event_id", 86400)
