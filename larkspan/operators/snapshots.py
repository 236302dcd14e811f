"""Snapshots of a corpus: diffs, renames, views, upserts, chunk replacement, the vector cache."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.functions import text as tx


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by one full outer join."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def renames(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(old key, new key) of removed and added files with the same digest, where it is unique on both sides."""
    gone = old.join(new.select(key), key, "left_anti").groupBy(digest).agg(F.count("*").alias("_n"), F.min(key).alias("renamed_from")).where("_n = 1").drop("_n")
    came = new.join(old.select(key), key, "left_anti").groupBy(digest).agg(F.count("*").alias("_n"), F.min(key).alias("renamed_to")).where("_n = 1").drop("_n")
    return gone.join(came, digest).select("renamed_from", "renamed_to")


def stale_files(stored: DataFrame, disk: DataFrame, key: str, stats: list[str]) -> DataFrame:
    """(key, state) of files whose stat differs from the stored one, is new, or is gone."""
    a = stored.select(key, *[F.col(s).alias(f"_{s}") for s in stats], F.lit(1).alias("_in"))
    b = disk.select(key, *stats, F.lit(1).alias("_on"))
    same = F.lit(True)
    for s in stats:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    state = F.when(F.col("_in").isNull(), "new").when(F.col("_on").isNull(), "removed").when(~same, "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``rows`` inserted or replacing the rows of the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def merge_columns(table: DataFrame, rows: DataFrame, key: list[str], add: list[str]) -> DataFrame:
    """Upsert of counters: columns of ``add`` are summed, the others take the new value where there is one."""
    a, b = table.alias("a"), rows.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = a.join(b, on, "full_outer")
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key]
    for c in table.columns:
        if c in key:
            continue
        out.append((F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0)) if c in add else F.coalesce(f"b.{c}", f"a.{c}")).alias(c))
    return joined.select(*out)


def replace_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """The chunk table with all chunks of the changed files replaced by fresh ones."""
    return chunks.join(changed.select(path).distinct(), path, "left_anti").unionByName(fresh)


def write_partitions(df: DataFrame, where: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(where)


def publish(df: DataFrame, where: str, failures: int = 0) -> bool:
    """Write a new generation beside the old one and swap it in by two renames, only when nothing failed.

    Between the renames there is no table at ``where``; ``store.Store`` has no such moment, for readers that go through it.
    """
    if failures:
        return False
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    fresh, old = f"{where}.new-{uuid.uuid4().hex}", f"{where}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(where)):
        fs.rename(path(where), path(old))
    fs.rename(path(fresh), path(where))
    fs.delete(path(old), True)
    return True


def cache_misses(texts: DataFrame, cache: DataFrame, contract: Column, text: Column, *kept: Column, key: str = "key") -> DataFrame:
    """Distinct contents that have no vector yet, one row for each content key, with the aggregates ``kept`` over all of its rows.

    A null text has no key. Only what the aggregates need is shuffled, not the texts.
    """
    rows = texts.withColumn(key, tx.content_key(contract, text)).where(F.col(key).isNotNull())
    wanted = rows.groupBy(key).agg(*kept) if kept else rows.select(key).distinct()
    return wanted.join(cache.select(key), key, "left_anti")


def unused(cache: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return cache.join(live.select(key), key, "left_anti")


def multiset_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def view_inventory(files: DataFrame, current: DataFrame, view: str, label: str) -> DataFrame:
    """Stored views with their counts, the current one first, then by label."""
    n = files.groupBy(view, label).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    c = current.select(F.col(view), F.lit(True).alias("_c"))
    return n.join(c, view, "left").withColumn("current", F.coalesce("_c", F.lit(False))).drop("_c")


def chunk_counts(manifest: DataFrame, chunks: DataFrame, path: str = "path") -> DataFrame:
    """Each file with the number of its chunks and its last line, files without chunks included."""
    c = chunks.groupBy(path).agg(F.count("*").alias("chunks"), F.max("end_line").alias("last_line"))
    return manifest.select(path).join(c, path, "left").fillna(0, ["chunks"])


def rebuild_lines(chunks: DataFrame, path: str = "path") -> DataFrame:
    """(path, line, text, conflict): lines of overlapping chunks, the first chunk's version of each.

    With a column ``part``, the parts of a line that was cut by characters are one chunk again.
    """
    if "part" in chunks.columns:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
        chunks = chunks.groupBy(path, "start_line").agg(F.array_join(parts, "").alias("text"))
    lines = chunks.select(path, "start_line", F.posexplode(F.split("text", "\n")).alias("pos", "line_text")).withColumn("line", F.col("start_line") + F.col("pos"))
    w = Window.partitionBy(path, "line").orderBy("start_line")
    same = Window.partitionBy(path, "line")
    out = lines.withColumn("_rn", F.row_number().over(w)).withColumn("conflict", F.min("line_text").over(same) != F.max("line_text").over(same))
    return out.where("_rn = 1").select(path, "line", F.col("line_text").alias("text"), "conflict")


def rebuild_text(chunks: DataFrame, path: str = "path") -> DataFrame:
    """(path, text, gaps, conflicts): whole files put together from their chunks."""
    lines = rebuild_lines(chunks, path)
    return lines.groupBy(path).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"),
        (F.max("line") - F.min("line") + 1 - F.count("*")).alias("gaps"), F.sum(F.col("conflict").cast("int")).alias("conflicts"),
    )
