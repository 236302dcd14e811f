"""Structured Streaming forms of the event operators.

Everything is keyed and event-timed; state is bounded by a watermark or is one
small value for each key, kept for good. The operators that count in order
hold one key's events of one batch at a time. Tests hold each stream against its batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspan.session import scratch_root, ship

GAPS = (60, 120, 240, 480, 900)
#: State that is as large as the data: stores on disk (those that have timers, too), with native memory for all of an executor together.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def parquet_stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A file stream over a Parquet file or folder of files.

    A stream does not take the path of a single file, but takes a pattern that only that file matches.
    """
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Drain what is available now and return it: all appended rows, or the last complete result.

    Each batch is written under its number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    where = f"{scratch_root(spark)}/larkspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={'last' if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows").select(stream.columns)


def hourly_counts(events: DataFrame, ts: str, by: list[str], watermark: str = "2 hours", size: str = "1 hour") -> DataFrame:
    w = F.window(ts, size)
    return events.withWatermark(ts, watermark).groupBy(w, *by).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("hour"), *by, "calls")


def bursts(events: DataFrame, ts: str, by: list[str], item: Column, quiet: str = "5 seconds", overflow: int = 1000, watermark: str = "1 minute") -> DataFrame:
    """Debounced sets of changes: one row for each burst that a quiet time ends; too many items ask for a full comparison.

    Items are counted exactly: a burst keeps the set of them, so its state is as large as what it holds. State is on
    disk (RocksDB), its memory bounded for all stores of an executor.
    """
    for name, value in ON_DISK.items():
        events.sparkSession.conf.set(name, value)
    s = F.session_window(ts, quiet)
    out = events.withWatermark(ts, watermark).groupBy(s, *by).agg(F.count("*").alias("events"), F.size(F.collect_set(item)).cast("long").alias("items"))
    return out.select(*by, F.col("session_window.start").alias("first_at"), "events", "items", (F.col("items") > overflow).alias("full_scan"))


def breaker(events: DataFrame, key: str, ts: str, tie: str, outcome: str, trip: int = 3, pause: int = 30) -> DataFrame:
    """(key, tie, busy_count, opens): the circuit breaker with one counter of state for each key.

    ``outcome`` is busy, ok or anything else, which changes nothing. The count
    survives the pause, so the next busy answer opens it again.
    """
    ship(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, busy_count long, opens boolean"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = []
        for pdf in [pd.concat(list(parts))]:
            for t, o in pdf.sort_values([ts, tie])[[tie, outcome]].itertuples(index=False):
                count = count + 1 if o == "busy" else 0 if o == "ok" else count
                rows.append((k[0], t, count, bool(o == "busy" and count >= trip)))
        state.update((count,))
        yield pd.DataFrame(rows, columns=[key, tie, "busy_count", "opens"])

    return events.groupBy(key).applyInPandasWithState(step, out, "count long", "append", GroupStateTimeout.NoTimeout)


def once_a_day(alerts: DataFrame, key: str, ts: str, tie: str, every: int = 86_400) -> DataFrame:
    """(key, tie): alerts not preceded by one that was sent for the key within ``every`` seconds."""
    ship(alerts.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        sent = []
        pdf = pd.concat(list(parts)).sort_values([ts, tie])
        for at, t in pdf[[ts, tie]].itertuples(index=False):
            now = at.timestamp()
            if last is None or now - last >= every:
                last = now
                sent.append((k[0], t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(sent, columns=[key, tie])

    return alerts.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}", "last double", "append", GroupStateTimeout.NoTimeout)


def next_gap(level: int, last: float | None, now: float, gaps: tuple[int, ...] = GAPS) -> tuple[int, bool]:
    """(level, run?): jobs are let through one gap apart; each grows the gap, a quiet time of twice the gap resets it."""
    if last is None or now - last >= 2 * gaps[level]:
        return 0, True
    if now - last >= gaps[level]:
        return min(level + 1, len(gaps) - 1), True
    return level, False


def adaptive_jobs(events: DataFrame, key: str, ts: str, tie: str, gaps: tuple[int, ...] = GAPS) -> DataFrame:
    """(key, tie, gap): the events that start a job, under the adaptive gap of each key."""
    ship(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (0, None)
        rows = []
        for at, t in pd.concat(list(parts)).sort_values([ts, tie])[[ts, tie]].itertuples(index=False):
            level, go = next_gap(level, last, at.timestamp(), gaps)
            if go:
                last = at.timestamp()
                rows.append((k[0], t, gaps[level]))
        state.update((level, last))
        yield pd.DataFrame(rows, columns=[key, tie, "gap"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, gap int", "level int, last double", "append", GroupStateTimeout.NoTimeout)


def in_flight(requests: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """Requests without those whose key is already under way."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def claim(queue: DataFrame, now: Column, budget: int, size: str = "size", lease: int = 120, attempts: int = 2) -> DataFrame:
    """The queue with the oldest claimable rows, up to ``budget`` of size in all, leased from ``now``.

    Claimable is what is pending, or leased and expired, with attempts left; what has none left fails.
    """
    free = (F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("lease_until") < now))
    spent = free & (F.col("attempts") >= attempts)
    ok = free & ~spent
    w = Window.partitionBy(ok).orderBy(F.col("updated_at").asc_nulls_last(), "id")
    used = F.sum(size).over(w)
    take = ok & (used <= budget)
    return queue.withColumns({"_take": take, "_spent": spent}).withColumns({
        "status": F.when(F.col("_spent"), "failed").when(F.col("_take"), "leased").otherwise(F.col("status")),
        "attempts": F.col("attempts") + F.col("_take").cast("int"),
        "lease_until": F.when(F.col("_take"), now + F.make_interval(secs=F.lit(lease))).otherwise(F.col("lease_until")),
    }).drop("_take", "_spent")


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Leased rows done or pending again by their result (id, ok); rows of other states stay."""
    r = results.select("id", F.col("ok").alias("_ok"))
    status = F.when((F.col("status") == "leased") & F.col("_ok").isNotNull(), F.when(F.col("_ok"), "done").otherwise("pending")).otherwise(F.col("status"))
    return queue.join(r, "id", "left").withColumn("status", status).drop("_ok")


def clear_flags(flags: DataFrame, jobs: DataFrame) -> DataFrame:
    """Dirty flags (id, seq) that no finished job (id, seq) covers: a job clears what was raised at or before its number."""
    done = jobs.groupBy("id").agg(F.max("seq").alias("_done"))
    return flags.join(done, "id", "left").where(F.col("_done").isNull() | (F.col("seq") > F.col("_done"))).drop("_done")
