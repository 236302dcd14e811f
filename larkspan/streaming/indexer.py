"""Incremental indexing as a stream: every batch of file changes becomes one commit, or nothing.

A batch is reduced to the last change of each file, compared with the manifest
by digest, and what is new is chunked and indexed into a generation of files,
chunks and postings. One commit of the store makes all of it visible and
remembers the number of the batch. A batch that is killed on the way leaves
nothing that a reader sees; run again, it starts anew; run again after its
commit, it does nothing. So each change is applied exactly once, and readers
see files, chunks and postings of one state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspan.operators import postings
from larkspan.operators.store import Store
from larkspan.sources import corpus

#: Weights of the indexed columns of a chunk.
FIELDS = {"path": 3.0, "chunk": 1.0}


def last_changes(changes: DataFrame, order: Column) -> DataFrame:
    """(path, text, deleted) of the last change of each path."""
    kept = F.max_by(F.struct("text", "deleted"), order).alias("c")
    return changes.groupBy("path").agg(kept).select("path", "c.text", F.coalesce("c.deleted", F.lit(False)).alias("deleted"))


def live_files(store: Store, state: dict | None = None) -> DataFrame | None:
    """(path, digest, size, version) of the files of a state: the last version of each that is not a deletion."""
    files = store.read("files", state or store.current())
    if files is None:
        return None
    last = files.groupBy("path").agg(F.max_by(F.struct("digest", "size", "deleted", "version"), "version").alias("f"))
    return last.where("NOT f.deleted").select("path", "f.digest", "f.size", "f.version")


def live_chunks(store: Store, state: dict | None = None) -> DataFrame | None:
    """(id, path, start_line, end_line, part, chunk) of the live files."""
    state = state or store.current()
    chunks, files = store.read("chunks", state), live_files(store, state)
    return None if chunks is None else chunks.join(files.select("path", "version"), ["path", "version"]).drop("version", "gen")


def apply_changes(store: Store, changes: DataFrame, order: Column, batch: tuple[str, int], shard_docs: int = postings.SHARD_DOCS, buckets: int = postings.BUCKETS) -> dict:
    """Index one batch of ``changes`` (path, text, deleted, and what ``order`` needs); returns the state afterwards.

    A file whose digest is that of the manifest is left alone, and so is the
    deletion of a file that is not there. A null text is an empty file, which
    has no chunks. Nothing is committed for a batch that the state has seen.
    """
    state = store.current()
    if store.seen(*batch, state):
        return state
    gen, version = store.generation(), state["version"] + 1
    text = F.coalesce("text", F.lit(""))
    new = last_changes(changes, order).select("path", "deleted", text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), F.octet_length(text).alias("size"))
    known = live_files(store, state)
    if known is None:
        new = new.where("NOT deleted")
    else:
        both = new.join(known.select("path", F.col("digest").alias("was")), "path", "left")
        new = both.where(F.when(F.col("deleted"), F.col("was").isNotNull()).otherwise(~F.col("digest").eqNullSafe(F.col("was")))).drop("was")
    # the texts that change are read from the source once
    new = store.write("changed", gen, new.withColumn("version", F.lit(version)))
    files = store.write("files", gen, new.select("path", "digest", "size", "deleted", "version"))
    cut = corpus.chunks(new.where("NOT deleted AND text <> ''"))
    key = F.concat_ws("#", "path", F.lit(version), "start_line", "part").alias("id")
    chunks = store.write("chunks", gen, cut.select(key, "path", "start_line", "end_line", "part", "chunk", F.lit(version).alias("version")))
    old = live_chunks(store, state)
    gone = None if old is None else old.join(files.select("path"), "path", "left_semi").select("id")
    return postings.update(
        store, chunks, FIELDS, "id", keep=("path",), removed=gone, batch=batch, shard_docs=shard_docs, buckets=buckets,
        extra={"files": gen, "chunks": gen}, base=state,
    )


def index_stream(changes: DataFrame, store: Store, order: Column, checkpoint: str, name: str = "changes", **options):
    """Start the query that applies a stream of ``changes``, batch by batch, until what is available now is indexed.

    ``name`` tells sources apart; a source keeps its checkpoint, since batches are known by their numbers there.
    """
    def put(batch: DataFrame, number: int) -> None:
        apply_changes(store, batch, order, (name, number), **options)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
