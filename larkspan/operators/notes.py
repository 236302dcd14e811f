"""Notes and evidence: units of notes, term scores, windows, citations, changed hunks, orders of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.functions import text as tx


def units(notes: DataFrame, by: list[str], line: str, text: str) -> DataFrame:
    """(by, unit, start, lines): a unit starts at a heading or a bullet in column 0."""
    starts = F.col(text).rlike("^(#{1,6}\\s|[-*]\\s)")
    marked = notes.withColumn("unit", F.sum(starts.cast("int")).over(Window.partitionBy(*by).orderBy(line)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: x[text])
    return marked.groupBy(*by, "unit").agg(F.min(line).alias("start"), ordered.alias("lines"))


def unit_score(lines: Column, terms: Column) -> Column:
    """Distinct terms in the unit; one in its first line counts twice."""
    return tx.matched(terms, F.array_join(lines, " ")) + tx.matched(terms, F.get(lines, F.lit(0)))


def evidence_windows(windows: DataFrame, by: list[str], start: str, end: str, score: str, per: int = 2) -> DataFrame:
    """At most ``per`` windows of a file that do not overlap, best first.

    A fold over one file's windows; files are independent.
    """
    best = windows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(start).alias("s"), F.col(end).alias("e")))).alias("_w"))
    none = F.array().cast("array<struct<o:bigint,s:bigint,e:bigint>>")
    typed = F.transform("_w", lambda w: F.struct(w["o"].cast("bigint").alias("o"), w["s"].cast("bigint").alias("s"), w["e"].cast("bigint").alias("e")))
    fold = F.aggregate(typed, none, lambda got, w: F.when((F.size(got) < per) & ~F.exists(got, lambda g: (g["s"] <= w["e"]) & (g["e"] >= w["s"])), F.concat(got, F.array(w))).otherwise(got))
    return best.select(*by, F.posexplode(fold).alias("place", "_x")).select(*by, (F.col("place") + 1).alias("place"), F.col("_x.s").alias(start), F.col("_x.e").alias(end), (-F.col("_x.o")).alias(score))


def clip(first: Column, last: Column, lines: Column) -> tuple[Column, Column, Column]:
    """A cited range clipped to the file, and whether anything is left of it."""
    a, b = F.greatest(first, F.lit(1)), F.least(last, lines)
    return a, b, a <= b


def drop_overlaps(cites: DataFrame, by: list[str], order: str, first: str, last: str) -> DataFrame:
    """Citations that no earlier one of the same file overlaps."""
    w = Window.partitionBy(*by).orderBy(first, order).rowsBetween(Window.unboundedPreceding, -1)
    return cites.withColumn("_seen", F.max(last).over(w)).where(F.col("_seen").isNull() | (F.col("_seen") < F.col(first))).drop("_seen")


def top_hunks(hunks: DataFrame, by: str, position: str, score: str, files: int, per: int) -> DataFrame:
    """The best hunks of the best files, back in their order in the file."""
    total = hunks.groupBy(by).agg(F.sum(score).alias("_t")).orderBy(F.col("_t").desc(), by).limit(files)
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), position)
    kept = hunks.join(total, by).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(position))).drop("_rn", "_t")


def code_first(rows: DataFrame, by: list[str], kind: str, score: str, tie: str, k: int) -> DataFrame:
    """``k`` rows with code first, a place kept for the best document and the best test."""
    w = Window.partitionBy(*by, kind).orderBy(F.col(score).desc(), tie)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    kept = (F.col(kind) != "code") & (F.col("_rn") == 1)
    group = F.when(kept, 0).when(F.col(kind) == "code", 1).otherwise(2)
    chosen = ranked.withColumn("_c", F.row_number().over(Window.partitionBy(*by).orderBy(group, F.col(score).desc(), tie))).where(F.col("_c") <= k)
    order = Window.partitionBy(*by).orderBy(F.when(F.col(kind) == "code", 0).otherwise(1), F.col(score).desc(), tie)
    return chosen.withColumn("place", F.row_number().over(order)).drop("_rn", "_c")


def test_order(rows: DataFrame, changed: Column, hops: str, named: Column, depth: str, path: str) -> DataFrame:
    """Tests by: changed themselves, call hops, name match, import depth, path; unknown distances last."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(changed.desc(), F.col(hops).asc_nulls_last(), named.desc(), F.col(depth).asc_nulls_last(), path)))


def percent(share: Column) -> Column:
    """Hundredths, cut off."""
    return (share * 100).cast("int")


def pause_seconds(asked: Column, low: int = 30, high: int = 3600) -> Column:
    return F.least(F.greatest(asked, F.lit(low)), F.lit(high))


def route(query: Column) -> Column:
    """Which engine a question goes to, by its shape; the first rule that applies."""
    return (
        F.when(query.rlike("(?i)\\bsite:|^https?://"), "web").when(query.rlike("(?i)\\b(cve|vulnerab|security advis)"), "advisories")
        .when(query.rlike("\\.(py|js|ts|go|java)\\b|\\w+\\(\\)|_\\w+"), "code").otherwise("documents")
    )
