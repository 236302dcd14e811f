"""Composite reports and set algebra over derived graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import text as tx
from larkspan.operators import history as hi, impact as im, snapshots as sn
from larkspan.plans.registry import query
from larkspan.session import table


def _calls(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 46").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100 + 1).alias("target")).distinct()


_CALLS = "c AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 100 + 1 AS target FROM lineitem WHERE l_quantity >= 46)"


@query("change_impact", f"""
WITH RECURSIVE {_CALLS}, s AS (SELECT s_suppkey AS id, s_nationkey AS path, s_suppkey * 10 AS a, s_suppkey * 10 + 25 AS b FROM supplier),
g AS (SELECT 3 AS path, n * 7 AS line FROM range(0, 200) t(n)), h AS (SELECT DISTINCT id, s.path, a, b FROM s JOIN g ON s.path = g.path AND line BETWEEN a AND b),
i AS (SELECT id FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.path = x.path AND y.a >= x.a AND y.b <= x.b AND (y.a <> x.a OR y.b <> x.b))),
w(node, depth) AS (SELECT id, 0 FROM i UNION SELECT source, depth + 1 FROM w JOIN c ON target = node WHERE depth < 2)
SELECT s.id, s.path, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'changed' WHEN s.id % 4 = 0 THEN 'test' ELSE 'caller' END AS role FROM w JOIN s ON s.id = node GROUP BY s.id, s.path""")
def change_impact(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("path"), (F.col("s_suppkey") * 10).alias("start_line"), (F.col("s_suppkey") * 10 + 25).alias("end_line"))
    changes = spark.range(200).select(F.lit(3).alias("path"), (F.col("id") * 7).alias("line"))
    return im.change_impact(s, _calls(spark, d), changes, F.col("id") % 4 == 0, 2)


@query("move_preview", f"""
WITH {_CALLS} SELECT source, target, CASE WHEN target = 7 THEN 9999 ELSE target END AS rewritten, CASE WHEN source = 7 THEN 'own import' ELSE 'importer' END AS side FROM c WHERE source = 7 OR target = 7""")
def move_preview(spark, d):
    return im.move_edges(_calls(spark, d), 7, 9999)


@query("rename_preview", """
SELECT DISTINCT place, kind FROM (SELECT l_suppkey::VARCHAR AS place, 'call' AS kind FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 UNION ALL
  SELECT doc_id::VARCHAR, 'mention' FROM documents WHERE regexp_matches(text, '(^|[^\\w.])License($|\\W)'))""")
def rename_preview(spark, d):
    calls = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").cast("string").alias("source"), F.when(F.col("l_returnflag") == "R", "m::License").otherwise("x").alias("target"))
    return im.rename_sites(calls, table(spark, d, "documents"), "m::License", F.col("text"), "doc_id")


@query("entry_tests", f"""
WITH RECURSIVE {_CALLS}, w(test, node, n) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT test, target, n + 1 FROM w JOIN c ON source = node WHERE n < 2),
r AS (SELECT node, count(DISTINCT test) AS tests FROM w GROUP BY node)
SELECT s_suppkey AS entry, coalesce(tests, 0) AS tests FROM supplier LEFT JOIN r ON node = s_suppkey WHERE s_suppkey % 7 = 0""")
def entry_tests(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return im.entry_tests(_calls(spark, d), s.where("id % 7 = 0"), s.where("id % 10 = 0"), 2)


@query("module_weights", """
SELECT l_suppkey % 10 AS a, l_partkey % 10 AS b, count(*) AS calls FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 10 GROUP BY ALL ORDER BY calls DESC, a, b LIMIT 60""")
def module_weights(spark, d):
    return im.module_weights(table(spark, d, "lineitem"), F.col("l_suppkey") % 10, F.col("l_partkey") % 10)


@query("hotspot_rank", """
WITH h AS (SELECT l_suppkey AS file, count(DISTINCT l_orderkey) AS commits, count(DISTINCT l_orderkey) * any_value(length(s_name)) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey)
SELECT file, row_number() OVER (ORDER BY score DESC, file)::INT AS rank FROM (SELECT * FROM h WHERE commits >= 10 ORDER BY score DESC, file LIMIT 10)""")
def hotspot_rank(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file"), F.col("l_shipdate").alias("time"))
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.length("s_name").alias("lines"))
    return im.hotspot_rank(hi.hotspots(li, sizes, "file", "commit", "time"), "file")


@query("justified_entries", """
SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 11 = 0 THEN 'launched' END, CASE WHEN s_acctbal > 9000 THEN 'public' END, CASE WHEN s_nationkey = 1 THEN 'main' END], lambda x: x IS NOT NULL) AS reasons,
  s_suppkey % 11 = 0 OR s_acctbal > 9000 OR s_nationkey = 1 AS ok FROM supplier""")
def justified_entries(spark, d):
    return im.justified(table(spark, d, "supplier"), "s_suppkey", {"launched": F.col("s_suppkey") % 11 == 0, "public": F.col("s_acctbal") > 9000, "main": F.col("s_nationkey") == 1})


@query("link_multiset", """
SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0 EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1""")
def link_multiset(spark, d):
    li = table(spark, d, "lineitem")
    return sn.multiset_minus(li.where("l_orderkey % 2 = 0").select("l_suppkey", "l_returnflag"), li.where("l_orderkey % 2 = 1").select("l_suppkey", "l_returnflag"))


@query("path_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def path_union(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("changed_dependencies", """
SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1""")
def changed_dependencies(spark, d):
    p = table(spark, d, "part")
    return p.where("p_partkey % 2 = 0").select("p_brand", "p_size").distinct().join(p.where("p_partkey % 2 = 1").select("p_brand", "p_size").distinct(), ["p_brand", "p_size"], "left_anti")


@query("compact_text", r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(\p{L})-\n(\p{Ll})', '\1\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(replace(regexp_replace(t, '\n{2,}', chr(1), 'g'), chr(10), ' '), '[ \t]+', ' ', 'g') AS t FROM a)
SELECT doc_id, length(trim(replace(t, chr(1), chr(10) || chr(10)), ' '))::INT AS chars FROM b""")
def compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.compact_pages(F.col("text")).alias("text")).select("doc_id", F.length("text").alias("chars"))
