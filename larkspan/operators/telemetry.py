"""Rollups over call logs: usage, volume alerts, success windows, attribution, failures, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FOLLOW_SECONDS = 900
ALERT_FLOOR, ALERT_FACTOR, ALERT_HOURS = 100, 2, 168
# What error texts say.
STATUS = "HTTP(?: Error)? (\\d{3})"
TIMED_OUT = "(?i)timed out|timeout|WinError 10060|Errno 110\\b"
NO_CONNECTION = "(?i)URLError|ConnectionError|ConnectionRefused|ConnectionReset|refused|reset|getaddrinfo|WinError 1006[01]|WinError 10054|Name or service|unreachable"
FAILING_CALLS, FAILING_RATE = 5, 0.5


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_hour(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600)


def nullable_sum(value: Column, reported: Column) -> Column:
    """Sum of a counter, null rather than 0 where it was never reported."""
    return F.when(F.sum(F.when(reported, 1).otherwise(0)) > 0, F.sum(F.when(reported, value)))


def usage_rollup(calls: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row for each value of ``by`` and one with nulls for the total."""
    return calls.groupingSets([by, []], *by).agg(*[c.alias(n) for n, c in measures.items()])


def volume_alerts(
    calls: DataFrame, ts: str, by: list[str], floor: float = ALERT_FLOOR, factor: float = ALERT_FACTOR, hours: int = ALERT_HOURS,
) -> DataFrame:
    """Every hour with calls of each group, with the nearest-rank p99 of the hours with calls among the ``hours`` before it.

    An hour alerts if its calls exceed the larger of ``floor`` and ``factor``
    times that percentile; the hour itself is not part of its baseline.
    """
    hourly = calls.groupBy(*by, epoch_hour(F.col(ts)).alias("hour")).agg(F.count("*").alias("calls"))
    past = Window.partitionBy(*by).orderBy("hour").rangeBetween(-hours, -1)
    ranked = F.array_sort(F.collect_list("calls").over(past))
    n = F.size("_past")
    out = hourly.withColumn("_past", ranked)
    out = out.withColumn("p99", F.when(n > 0, F.get("_past", (F.ceil(n * 99 / 100) - 1).cast("int"))))
    limit = F.greatest(F.lit(float(floor)), factor * F.coalesce("p99", F.lit(0)).cast("double"))
    return out.withColumn("threshold", limit).withColumn("alert", F.col("calls") > F.col("threshold")).drop("_past")


def last_n_rate(calls: DataFrame, by: list[str], order: list[Column], success: Column, counted: Column, n: int = 20) -> DataFrame:
    """Success rate of the last ``n`` counted calls of each group; null where none is counted."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    recent = calls.where(counted).withColumn("_rn", last).where(F.col("_rn") <= n)
    rates = recent.groupBy(*by).agg(F.avg(success.cast("double")).alias("rate"), F.count("*").alias("counted"))
    return calls.select(*by).distinct().join(rates, by, "left").fillna(0, ["counted"])


def next_event(events: DataFrame, session: str, ts: str, tie: str, within: int = FOLLOW_SECONDS, carry: tuple = ()) -> DataFrame:
    """``events`` with ``next_<column>`` of the following event of the session, where it is at most ``within`` seconds later."""
    w = Window.partitionBy(session).orderBy(ts, tie)
    gap = micros(F.lead(ts).over(w)) - micros(F.col(ts))
    return events.withColumn("_gap", gap).withColumns(
        {f"next_{c}": F.when(F.col("_gap") <= within * 1_000_000, F.lead(c).over(w)) for c in carry}
    ).drop("_gap")


def reason_shape(c: Column) -> Column:
    """A message with its numbers replaced, so that alike messages group."""
    return F.regexp_replace(c, "\\d+", "N")


def failure_class(error: Column) -> Column:
    """Class of an error text: a status code in it wins over its words."""
    e = F.coalesce(error, F.lit(""))
    code = F.nullif(F.regexp_extract(e, STATUS, 1), F.lit("")).cast("int")
    return (
        F.when(e.startswith("CircuitOpen:"), "circuit_open")
        .when(code.isin(429, 503), code.cast("string")).when(code.isin(401, 403), "auth")
        .when(code >= 500, "5xx").when(code.isNotNull(), "other")
        .when(e.rlike(TIMED_OUT), "timeout").when(e.rlike(NO_CONNECTION), "connection").otherwise("other")
    )


def failure_rates(calls: DataFrame, by: list[str], ts: str, failed: Column, error: Column) -> DataFrame:
    """Calls, errors, rate to three digits, last error, and whether the group is failing."""
    out = calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum(failed.cast("int")).alias("errors"),
        F.max_by(F.when(failed, error), F.when(failed, F.col(ts))).alias("last_error"),
    )
    rate = F.col("errors") / F.col("calls")
    return out.withColumns({"rate": F.bround(rate, 3), "failing": (F.col("calls") >= FAILING_CALLS) & (rate >= FAILING_RATE)})


def failure_groups(failures: DataFrame, by: list[str], ts: str, tie: str, sample: str, newest: int = 3) -> DataFrame:
    """Failures of each group: count, first and last time, a sample (the newest), and the newest few ids, newest first."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    ranked = failures.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"),
        F.min(F.when(F.col("_rn") == 1, F.col(sample))).alias("sample"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= newest, F.struct("_rn", tie)))), lambda x: x[tie]).alias("newest"),
    )


def requester_summary(calls: DataFrame, by: list[str], session: str, failed: Column, ts: str, source: str) -> DataFrame:
    return calls.groupBy(*by).agg(
        F.countDistinct(session).alias("sessions"), F.count("*").alias("calls"), F.sum(failed.cast("int")).alias("failed"),
        F.max(ts).alias("last_at"), F.sort_array(F.collect_set(source)).alias("sources"),
    )


def retain(df: DataFrame, ts: str, now: Column, days: int | None = None, newest: int | None = None, by: tuple = (), tie: str | None = None) -> DataFrame:
    """Rows no older than ``days`` and among the ``newest`` of their group."""
    out = df if days is None else df.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))
    if newest is not None:
        w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), *([F.col(tie).desc()] if tie else []))
        out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest).drop("_rn")
    return out


def trailing_rate(events: DataFrame, by: list[str], ts: str, seconds: int = 3600) -> DataFrame:
    """``events`` with ``in_window``: the events of the group in the trailing ``seconds``, itself included."""
    w = Window.partitionBy(*by).orderBy(micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def breaker_states(calls: DataFrame, by: list[str], ts: str, tie: str, busy: Column, success: Column, trip: int = 3, pause: int = 30) -> DataFrame:
    """Batch form of the circuit breaker: the consecutive busy count after each call, and whether it opens the pause.

    A success sets the count to zero and other outcomes leave it; the pause does
    not, so every busy call from the ``trip``-th on opens it again.
    """
    w = Window.partitionBy(*by).orderBy(ts, tie)
    run = calls.withColumn("_run", F.sum(success.cast("int")).over(w))
    inner = Window.partitionBy(*by, "_run").orderBy(ts, tie)
    out = run.withColumn("busy_count", F.sum(F.when(busy, 1).otherwise(0)).over(inner))
    return out.withColumns({
        "opens": busy & (F.col("busy_count") >= trip),
        "open_until": F.when(busy & (F.col("busy_count") >= trip), F.col(ts) + F.make_interval(secs=F.lit(pause))),
    }).drop("_run")


def debounce(events: DataFrame, by: list[str], ts: str, tie: str, item: Column, quiet: int = 5, overflow: int = 1000) -> DataFrame:
    """Bursts separated by more than ``quiet`` seconds: the distinct items of each, and whether they overflow."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap > quiet * 1_000_000), 1).otherwise(0))
    return (
        marked.withColumn("burst", F.sum("_new").over(w)).groupBy(*by, "burst")
        .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("events"), F.countDistinct(item).alias("items"))
        .withColumn("full_scan", F.col("items") > overflow)
    )


def progress(jobs: DataFrame, done: str, total: str, seconds: str) -> DataFrame:
    """``jobs`` with the percentage done and the seconds left at the speed so far; null before anything is done."""
    left = F.greatest(F.col(total) - F.col(done), F.lit(0))
    return jobs.withColumns({
        "percent": F.when(F.col(total) > 0, F.floor(100 * F.least(F.col(done), F.col(total)) / F.col(total))),
        "eta": F.when(F.col(done) > 0, F.ceil(left * F.col(seconds) / F.col(done))),
    })


def coalesced_writes(events: DataFrame, by: list[str], ts: str, tie: str, window: int) -> DataFrame:
    """(by, at, first, events): what is written where a first write goes out at once and the rest once a window.

    A key that was quiet for a window starts anew. ``at`` is the second of the
    first write of a run plus whole windows; ``first`` tells the immediate one.
    """
    w = Window.partitionBy(*by).orderBy(ts, tie)
    second = F.unix_micros(F.col(ts)) / 1_000_000
    timed = events.select(*by, ts, tie, second.alias("_s"))
    fresh = F.coalesce(F.col("_s") - F.lag("_s").over(w) >= window, F.lit(True))
    runs = timed.withColumn("_f", fresh).withColumn("_r", F.sum(F.col("_f").cast("int")).over(w))
    start = F.min("_s").over(Window.partitionBy(*by, "_r"))
    slot = F.when(F.col("_f"), 0).otherwise(F.floor((F.col("_s") - F.col("_t")) / window) + 1)
    return (
        runs.withColumn("_t", start).withColumn("_k", slot).groupBy(*by, "_r", "_k").agg(F.count("*").alias("events"), F.min("_t").alias("_t"))
        .select(*by, F.floor(F.col("_t") + F.col("_k") * window).alias("at"), (F.col("_k") == 0).alias("first"), "events")
    )
