"""Ordered operators: sliding windows, runs, budgets, interleaving, folder totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def best_window(lines: DataFrame, by: list[str], line: str, hits: Column, size: int) -> DataFrame:
    """(by, start, score): the window of ``size`` consecutive lines with most hits, the first on a tie; full windows only."""
    w = Window.partitionBy(*by).orderBy(line)
    scored = lines.withColumn("_h", hits).withColumns({
        "score": F.sum("_h").over(w.rowsBetween(0, size - 1)), "_n": F.count("*").over(Window.partitionBy(*by)), "_at": F.row_number().over(w)})
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), line)
    full = scored.where(F.col("_at") <= F.greatest(F.col("_n") - size + 1, F.lit(1)))
    return full.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*by, F.col(line).alias("start"), "score")


def runs(rows: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, start, end) of runs of consecutive numbers."""
    g = rows.withColumn("_r", F.col(line) - F.row_number().over(Window.partitionBy(*by).orderBy(line)))
    return g.groupBy(*by, "_r").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_r")


def fit_in_order(rows: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit; one that does not is skipped and later ones may still fit.

    The fold runs over one group's sorted (order, size) pairs, so a group is a page or a document, not a corpus.
    """
    pairs = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("_p"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>").alias("taken"))
    fold = F.aggregate("_p", start, lambda s, x: F.struct(
        F.when(x[size] <= s["left"], s["left"] - x[size]).otherwise(s["left"]).alias("left"),
        F.when(x[size] <= s["left"], F.concat(s["taken"], F.array(x[order]))).otherwise(s["taken"]).alias("taken"),
    ))
    return pairs.withColumn("_f", fold).select(*by, F.explode("_f.taken").alias(order))


def until_overflow(rows: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows in order up to the first that would exceed the budget, with the running total ``used``."""
    return rows.withColumn("used", F.sum(size).over(Window.partitionBy(*by).orderBy(order))).where(F.col("used") <= budget)


def interleave(rows: DataFrame, by: list[str], tier: Column, rank: str, priority: Column, url: str, limit: int | None = None) -> DataFrame:
    """Round-robin merge of ranked tiers with ``place``: by rank in the raw list, then tier priority.

    A url that came before is dropped and its tier loses that turn; rows without a url are all kept.
    """
    r = rows.withColumns({"_tier": tier, "_prio": priority})
    r = r.withColumn("_turn", F.row_number().over(Window.partitionBy(*by, "_tier").orderBy(rank)))
    seen = F.row_number().over(Window.partitionBy(*by, url).orderBy("_turn", "_prio", "_tier"))
    kept = r.withColumn("_seen", seen).where((F.col("_seen") == 1) | F.col(url).isNull() | (F.col(url) == ""))
    order = Window.partitionBy(*by).orderBy("_turn", "_prio", "_tier")
    out = kept.withColumn("place", F.row_number().over(order)).drop("_tier", "_prio", "_turn", "_seen")
    return out if limit is None else out.where(F.col("place") <= limit)


def folder_totals(rows: DataFrame, path: str, measures: dict[str, Column]) -> DataFrame:
    """Totals of every ancestor folder of a path, the root ('') included."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.withColumn("folder", F.explode(ancestors)).groupBy("folder").agg(*[c.alias(n) for n, c in measures.items()])
