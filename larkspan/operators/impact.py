"""Composite reports: what a change reaches, what a rename or move would touch, what tests reach each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.operators import graph as gr


def change_impact(symbols: DataFrame, calls: DataFrame, changes: DataFrame, is_test: Column, depth: int = gr.TEST_DEPTH) -> DataFrame:
    """(id, path, depth, role): the changed symbols (depth 0), their callers within ``depth``, and the tests among them.

    ``symbols`` (id, path, start_line, end_line), ``calls`` (source, target), ``changes`` (path, line).
    """
    lines = changes.withColumn("line_end", F.col("line"))
    hit = gr.interval_join(symbols, lines, "path", ("start_line", "end_line"), ("line", "line_end")).select("id", "path", "start_line", "end_line").distinct()
    seeds = gr.innermost(hit, "path", "start_line", "end_line", "id").select("id")
    reach = gr.bfs(calls, seeds, "target", "source", depth)
    role = F.when(F.col("depth") == 0, "changed").when(is_test, "test").otherwise("caller")
    return symbols.join(reach, F.col("id") == F.col("node")).select("id", "path", "depth", role.alias("role"))


def rename_sites(calls: DataFrame, mentions: DataFrame, symbol: str, text: Column, key: str) -> DataFrame:
    """(place, kind): call sites of a symbol and the lines of other files that name it."""
    name = symbol.rsplit("::", 1)[-1]
    called = calls.where(F.col("target") == symbol).select(F.col("source").alias("place"), F.lit("call").alias("kind"))
    named = mentions.where(text.rlike(f"(?<![\\w.]){name}(?!\\w)")).select(F.col(key).cast("string").alias("place"), F.lit("mention").alias("kind"))
    return called.union(named).distinct()


def move_edges(imports: DataFrame, path: str, new_path: str) -> DataFrame:
    """(source, target, rewritten, side): import edges that moving a file changes, and how they will read."""
    touched = imports.where((F.col("source") == path) | (F.col("target") == path))
    return touched.select(
        "source", "target", F.when(F.col("target") == path, F.lit(new_path)).otherwise(F.col("target")).alias("rewritten"),
        F.when(F.col("source") == path, "own import").otherwise("importer").alias("side"),
    )


def entry_tests(calls: DataFrame, entries: DataFrame, tests: DataFrame, depth: int = gr.FLOW_DEPTH) -> DataFrame:
    """(entry, tests): how many tests reach each entry within ``depth`` calls; 0 for none."""
    e = calls.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    front = tests.select(F.col("id").alias("test"), F.col("id").alias("node"))
    seen = front
    for _ in range(depth):
        front = front.join(e, F.col("node") == F.col("s")).select("test", F.col("t").alias("node")).distinct().join(seen, ["test", "node"], "left_anti")
        front = gr.materialize(front, "tests")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    n = seen.groupBy(F.col("node").alias("entry")).agg(F.countDistinct("test").alias("tests"))
    return entries.select(F.col("id").alias("entry")).join(n, "entry", "left").fillna(0, ["tests"])


def module_weights(calls: DataFrame, source_module: Column, target_module: Column, most: int = 60) -> DataFrame:
    """(a, b, calls): the heaviest call edges between different modules."""
    m = calls.select(source_module.alias("a"), target_module.alias("b")).where("a <> b")
    return m.groupBy("a", "b").agg(F.count("*").alias("calls")).orderBy(F.col("calls").desc(), "a", "b").limit(most)


def hotspot_rank(hotspots: DataFrame, file: str, most: int = 10, least_commits: int = 10) -> DataFrame:
    """(file, rank) of the hottest files that changed often enough."""
    top = hotspots.where(F.col("commits") >= least_commits).orderBy(F.col("score").desc(), file).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), file))).select(file, "rank")


def justified(entries: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """(key, reasons, ok): why a function counts as an entry point; it needs one reason at least."""
    r = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))
    return entries.select(key, r.alias("reasons"), (F.size(r) > 0).alias("ok"))
