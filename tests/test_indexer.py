"""The incremental indexer: batches, failures in between, batches run again, and the state against a plain one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larkspan.operators import postings
from larkspan.operators.store import Conflict, Store
from larkspan.sources.corpus import chunk_lines
from larkspan.streaming import indexer

SCHEMA = "path string, text string, deleted boolean, seq long"
BATCHES = [
    [("a.py", "def alpha():\n    return 1", False, 1), ("b.py", "beta gamma", False, 2), ("a.py", "def alpha():\n    return 2", False, 3), ("e.py", None, False, 4)],
    [("b.py", "beta gamma", False, 5), ("c.py", "\n".join(f"line {i} delta" for i in range(450)), False, 6), ("never.py", None, True, 7)],
    [("a.py", None, True, 8), ("c.py", "delta now short", False, 9), ("b.py", None, True, 10), ("b.py", "beta again", False, 11)],
    [("b.py", "beta again", False, 12)],
    [("d.py", "x" * 9000 + " epsilon", False, 13)],
]


def plain(batches):
    files = {}
    for path, text, deleted, _ in sorted((c for b in batches for c in b), key=lambda c: c[3]):
        files.pop(path, None)
        if not deleted:
            files[path] = text or ""
    return files


def check(store, spark, batches):
    files = plain(batches)
    got = {r["path"]: (r["digest"], r["size"]) for r in indexer.live_files(store).collect()}
    assert got == {p: (hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for p, t in files.items()}
    want = sorted((p, a, b, c) for p, t in files.items() if t for a, b, c in chunk_lines(t))
    assert sorted((r["path"], r["start_line"], r["end_line"], r["chunk"]) for r in indexer.live_chunks(store).collect()) == want
    # postings are those of an index that was built at once
    facts = store.current()["facts"]
    assert facts["n_docs"] == len(want)
    words = spark.createDataFrame([("q", ["alpha", "beta", "gamma", "delta", "epsilon", "return", "now", "again", "line", "py"])], "query_id string, terms array<string>")
    hits = postings.search(store, words, 1000, doc_id="id").join(indexer.live_chunks(store).select("id", "path", "start_line", "part"), "id")
    hits = {(r["path"], r["start_line"], r["part"]): round(r["score"], 6) for r in hits.collect()}
    fresh = Store(spark, store.where + "-fresh-" + str(store.current()["version"]))
    live = indexer.live_chunks(store).withColumn("id", F.concat_ws("#", "path", "start_line", "part"))
    postings.update(fresh, live, indexer.FIELDS, "id")
    once = {tuple(r["id"].split("#")): round(r["score"], 6) for r in postings.search(fresh, words, 1000, doc_id="id").collect()}
    assert {tuple(map(str, k)): s for k, s in hits.items()} == once and hits


@pytest.fixture
def source(spark, tmp_path):
    """A folder of one file a batch, and the stream over it."""
    def add(k):
        spark.createDataFrame(BATCHES[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(store):
        changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = indexer.index_stream(changes, store, F.col("seq"), str(tmp_path / "checkpoint"), shard_docs=3, buckets=2)
        q.awaitTermination()

    return add, run


def test_batches_and_failures(spark, source, tmp_path, monkeypatch):
    """A batch that dies at any of its writes leaves the state of before, and is applied once when it runs again."""
    add, run = source
    store = Store(spark, str(tmp_path / "store"))
    add(0)
    run(store)
    check(store, spark, BATCHES[:1])
    writes = ["changed", "files", "chunks", "documents", "postings", "dead", "terms", "commit"]
    for k, dies_at in ((1, writes), (2, ["files", "terms", "commit"])):
        add(k)
        for name in dies_at:
            before = store.current()
            with monkeypatch.context() as m:
                real = Store.write

                def write(self, table, gen, df, by=(), name=name, real=real):
                    out = real(self, table, gen, df, by)
                    if table == name:
                        raise RuntimeError(f"killed after {name}")
                    return out

                m.setattr(Store, "write", write)
                if name == "commit":
                    m.setattr(Store, "_put", lambda self, name, text: (_ for _ in ()).throw(RuntimeError("killed before the commit")))
                with pytest.raises(Exception, match="killed"):
                    run(store)
            assert store.current() == before
        run(store)
        assert store.current()["version"] == before["version"] + 1
        check(store, spark, BATCHES[: k + 1])


def test_a_batch_that_runs_again_after_its_commit_does_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    frames = [spark.createDataFrame(b, SCHEMA) for b in BATCHES]
    for k, df in enumerate(frames):
        state = indexer.apply_changes(store, df, F.col("seq"), ("src", k), shard_docs=3, buckets=2)
        assert indexer.apply_changes(store, df, F.col("seq"), ("src", k)) == state == store.current()
    check(store, spark, BATCHES)
    postings.compact(store, shard_docs=3)
    store.vacuum()
    check(store, spark, BATCHES)


def test_two_writers_of_one_state(spark, tmp_path, monkeypatch):
    """The slower of two commits fails as a whole, and its batch can be applied to the new state."""
    store = Store(spark, str(tmp_path / "store"))
    first, second = (spark.createDataFrame(b, SCHEMA) for b in BATCHES[:2])
    base = store.current()
    indexer.apply_changes(store, first, F.col("seq"), ("one", 0), shard_docs=3, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(Store, "current", lambda self, version=None: base)
        with pytest.raises(Conflict):
            indexer.apply_changes(store, second, F.col("seq"), ("two", 0), shard_docs=3, buckets=2)
    check(store, spark, BATCHES[:1])
    indexer.apply_changes(store, second, F.col("seq"), ("two", 0), shard_docs=3, buckets=2)
    check(store, spark, BATCHES[:2])
