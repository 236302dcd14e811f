"""Queries against their SQL on small tables made for what the given tables rarely have."""

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest

from pyspark.sql import functions as F

from larkspan.functions import text as tx
from larkspan.operators import duplicates as dd, retrieval
from larkspan.plans import registry
from larkspan.streaming import events as streams, timers


@pytest.fixture
def both(spark, tmp_path):
    """``both(query, table=(rows, schema), ...)``: the rows of the query and those of its SQL."""
    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = con.execute(registry.ORACLES[name])
        cols = [c[0] for c in want.description]
        plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r) for r in rows), key=repr)
        return plain(registry.QUERIES[name](spark, str(tmp_path)).select(*cols).collect()), plain(want.fetchall())

    return run


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts, langs=("en",)):
    return [(k, t, langs[k % len(langs)], f"src{k % 3}", len(t or "")) for k, t in enumerate(texts, 1)], DOCS


LONG_STARTS = [
    "x" * 9000 + "\n" * 100, "é" * 6000 + "\n" * 100, "é" * 9000 + "\n" * 100, "é" * 4095 + "\n" * 100, "y" * 9000, "", None, "a\n" * 600_000,
    "-----BEGIN RSA PRIVATE KEY-----\nx", "short", "w" * 3000, "w\n" * 2000, "é" * 1001,
]


def test_skip_reason_counts_by_characters(both):
    got, want = both("skip_reason_counts", documents=documents(*LONG_STARTS))
    assert got == want and {r[0] for r in want} == {"empty", "too_large", "minified", "indexed"}


def test_skip_reasons_by_characters(both):
    got, want = both("skip_reasons", documents=documents(*LONG_STARTS))
    assert got == want and {r[1] for r in want} == {"empty", "minified", "indexed"}


def test_a_content_has_the_least_language_of_its_copies(both):
    texts = [f"text {k % 40}" if k % 3 else f"other {k % 2}" for k in range(1, 300)]
    got, want = both("vector_cache_misses", documents=documents(*texts, langs=("fr", None, "de", "en", "es", "de", "it")))
    assert got == want and len(want) > 20


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def apart(kind, *seconds, users=100):
    """Events of each user so many seconds after the first, which is at any microsecond."""
    rnd, start, out = random.Random(2), datetime(2024, 1, 1), []
    for u in range(users):
        t = start + timedelta(microseconds=rnd.randrange(86_400_000_000))
        out += [(len(seconds) * u + k, t + timedelta(microseconds=round(s * 1e6)), u, kind, 0.5, "{}") for k, s in enumerate(seconds)]
    return out, EVENTS


def test_breaker_of_users_silent_for_exactly_two_hours(both):
    got, want = both("stream_breaker_idle", events=apart("error", 0, 7200, 7200.000001))
    assert got == want and len(want) == 300


def state_after_one_batch(spark, folder, fn, kind):
    """Rows of state when a batch of one key at 400 times has come, and the rows given at the end."""
    rows = [("k", datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k), k, kind) for k in range(400)]
    spark.createDataFrame(rows, "key string, ts timestamp, tie long, kind string").coalesce(1).write.parquet(f"{folder}/in")
    got: list = []
    stream = fn(spark.readStream.schema("key string, ts timestamp, tie long, kind string").parquet(f"{folder}/in"), "key", "ts", "tie", "kind")
    q = stream.writeStream.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    q.awaitTermination()
    return q.recentProgress[0]["stateOperators"][0]["numRowsTotal"], len(got)


def test_alerts_keep_a_batch_of_a_key_in_a_few_rows(spark, tmp_path):
    held, given = state_after_one_batch(spark, tmp_path, lambda *a: timers.alerts(*a, every=2), "alert")
    assert held < 20 and given == 200


def test_requests_keep_a_batch_of_a_key_in_a_few_rows(spark, tmp_path):
    held, given = state_after_one_batch(spark, tmp_path, lambda *a: timers.requests(*a, most=100), "request")
    assert held < 20 and given == 400


def test_bursts_count_items_exactly_and_keep_no_sketches(spark, tmp_path):
    rows = [(u, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k), f"item {k % 700}") for u in range(5) for k in range(900)]
    schema = "u long, ts timestamp, item string"
    spark.createDataFrame([*rows, (9, rows[0][1], None), (9, rows[1][1], "a")], schema).write.parquet(f"{tmp_path}/in")
    out = streams.bursts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", ["u"], F.col("item"), overflow=699)
    assert "approx_count_distinct" not in out._jdf.queryExecution().logical().toString()
    got = streams.run_available(out, "complete", "t").select("u", "events", "items", "full_scan").collect()
    assert sorted(map(tuple, got)) == [(u, 900, 700, True) for u in range(5)] + [(9, 2, 1, False)]


def families():
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 6, 20, 60, 90]))] for _ in range(25)]
    texts = [" ".join(w if rnd.random() > 0.01 else "Zé" for w in base[k % 25]) for k in range(150)]
    return [*texts, *texts[:30], *[base[0] and " ".join(base[3])] * 20, "", None, "a b c d", "A b C d", "a b c d e", "a b c d e"]


@pytest.mark.parametrize("held", [2000, 3])
def test_near_duplicates_with_copies(both, monkeypatch, held):
    monkeypatch.setattr(dd, "HELD", held, raising=False)
    got, want = both("near_duplicates_jaccard", documents=documents(*families()))
    assert got == want and len(want) > 300


def test_near_duplicates_shuffle_no_whole_sets(spark):
    docs = spark.createDataFrame([(k, " ".join(f"u{k}x{i}" for i in range(200))) for k in range(60)], "doc_id long, text string")
    seen = []
    keep, dd.materialize = dd.materialize, lambda df, name="t": seen.append((name, out := keep(df, name))) or out
    try:
        assert dd.jaccard_texts(docs, "doc_id", tx.words(F.col("text"))).count() == 0
    finally:
        dd.materialize = keep
    rows = {name: df for name, df in seen}
    assert rows["points"].agg(F.sum(F.size("post"))).first()[0] == 60 * 40 and rows["candidates"].count() == 0 and not {"shingles", "sets"} & set(rows)


def test_nearest_with_copies_and_many_blocks(both, spark):
    rnd = random.Random(4)
    vectors = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    rows = [(k, vectors[0] if k % 3 == 0 else vectors[k // 2], 1) for k in range(600)]
    got, want = both("knn_cosine", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert got == want and len(want) == 60
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    small = retrieval.knn(q, v, 7, "q", "vec_id", block=16)
    assert "NestedLoopJoin" not in small._jdf.queryExecution().toString() and "Cartesian" not in small._jdf.queryExecution().toString()
    plain = lambda df: sorted((r["q"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    assert plain(small) == plain(retrieval.knn(q, v, 7, "q", "vec_id"))


def test_best_counterpart_with_copies(both):
    got, want = both("best_counterpart_jaccard", documents=documents(*families()))
    assert got == want and len(want) >= 15


@pytest.mark.parametrize("sent", [10**6, 3])
def test_overlap_by_tasks_and_by_joins(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieval, "SENT_TERMS", sent)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcÄ.  ") for _ in range(rnd.randint(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 9)))) for i in range(90)] + [(90, None), (91, ""), (92, "x" * 3000 + "abc")]
    asked = [(q, [t for _ in range(4) if (t := word()).strip()]) for q in range(15)] + [(15, ["", "abc", "abc"]), (16, None)]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "query_id int, terms array<string>")
    out = retrieval.keyword_overlap(q, d, F.col("text"))
    want = {(k, i): sum(t != "" and t.lower() in x.lower() for t in ts) for k, ts in asked if ts for i, x in docs if x}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in out.collect()} == {k: n for k, n in want.items() if n}
    assert ("Exchange" in out._jdf.queryExecution().toString()) == (sent == 3)


def test_keyword_overlap_with_ids_that_repeat(both):
    rows, schema = documents(*[f"alpha beta gamma{k % 7} in Delta" * (k % 3) for k in range(60)])
    items = [(k, f"alpha gamma{k} delta beta{k} ta in") for k in range(6)]
    got, want = both("keyword_overlap_rank", documents=([*rows, *rows[:5]], schema), benchmark=(items, "item_id long, text string"))
    assert got == want and len(want) == 30
