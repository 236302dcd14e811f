"""History over ``orders`` and ``lineitem``: an order is a commit, a supplier or part a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import history as hi
from larkspan.plans.registry import query
from larkspan.session import table


def _changes(spark, d, file):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col(file).alias("file"))
    return lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("time")), "commit")


@query("hotspots", """
SELECT l_suppkey AS file, count(DISTINCT l_orderkey) AS commits, max(o_orderdate) AS last_change, any_value(length(s_name)) AS lines,
  count(DISTINCT l_orderkey) * any_value(length(s_name)) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey""")
def hotspots(spark, d):
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.length("s_name").alias("lines"))
    return hi.hotspots(_changes(spark, d, "l_suppkey"), sizes, "file", "commit", "time")


_COUPLING = """
WITH c AS (SELECT DISTINCT l_orderkey AS c, {file} AS f FROM lineitem),
s AS (SELECT c, f FROM c WHERE c IN (SELECT c FROM c GROUP BY c HAVING count(*) <= {cap})),
r AS (SELECT f, count(*) AS r FROM s GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS shared FROM s x JOIN s y ON x.c = y.c AND x.f < y.f GROUP BY ALL HAVING count(*) >= {shared}),
k AS (SELECT a, b, shared, shared / ((ra.r + rb.r) / 2) AS degree FROM p JOIN r ra ON ra.f = a JOIN r rb ON rb.f = b
      WHERE least(ra.r, rb.r) >= 5 AND shared / ((ra.r + rb.r) / 2) >= {degree})
"""


def _coupling(spark, d, file, cap, shared, degree):
    return hi.coupling(table(spark, d, "lineitem"), "l_orderkey", file, max_changeset=cap, min_shared=shared, min_degree=degree)


@query("change_coupling", _COUPLING.format(file="l_suppkey", cap=10, shared=5, degree=0.05) + "SELECT * FROM k")
def change_coupling(spark, d):
    return _coupling(spark, d, "l_suppkey", 10, 5, 0.05)


@query("change_coupling_parts", _COUPLING.format(file="l_partkey", cap=30, shared=2, degree=0.08) + "SELECT * FROM k")
def change_coupling_parts(spark, d):
    return _coupling(spark, d, "l_partkey", 30, 2, 0.08)


@query("coupling_linked", _COUPLING.format(file="l_suppkey", cap=10, shared=5, degree=0.05) + """
SELECT a, b, shared, degree, EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey <> s.s_nationkey AND
  least(s.s_suppkey, s.s_nationkey) = a AND greatest(s.s_suppkey, s.s_nationkey) = b) AS linked FROM k""")
def coupling_linked(spark, d):
    imports = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    return hi.linked(_coupling(spark, d, "l_suppkey", 10, 5, 0.05), imports, "s_suppkey", "s_nationkey")


@query("coupling_partners", _COUPLING.format(file="l_suppkey", cap=10, shared=5, degree=0.05) + """,
u AS (SELECT a AS changed, b AS partner, shared, degree FROM k UNION ALL SELECT b, a, shared, degree FROM k)
SELECT changed, partner, shared, degree FROM (
  SELECT *, row_number() OVER (PARTITION BY partner ORDER BY degree DESC, shared DESC, changed) AS rn FROM u
  WHERE changed <= 10 AND partner > 10) WHERE rn = 1""")
def coupling_partners(spark, d):
    changed = table(spark, d, "supplier").where("s_suppkey <= 10").select(F.col("s_suppkey").alias("file"))
    return hi.partners(_coupling(spark, d, "l_suppkey", 10, 5, 0.05), changed, "file").select("changed", "partner", "shared", "degree")


@query("glossary_terms", """
WITH t AS (SELECT p_partkey, p_name, unnest(list_distinct(list_transform(regexp_extract_all(p_name, '[A-Z]?[a-z]+|[A-Z]+|\\d+'), lambda x: lower(x)))) AS term FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p_name, p_partkey) AS k FROM t WHERE length(term) > 2)
SELECT term, count(DISTINCT p_partkey) AS uses, list(p_name ORDER BY k) FILTER (WHERE k <= 3) AS examples FROM r GROUP BY term HAVING count(DISTINCT p_partkey) >= 2""")
def glossary_terms(spark, d):
    return hi.glossary(table(spark, d, "part"), "p_name", "p_partkey")


@query("decision_candidates", """
SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)\\b(decid\\w*|replac\\w*|switch\\w*|migrat\\w*|adopt\\w*|drop\\w*|instead of|introduc\\w*|because|licen[sc]e\\w*)\\b') THEN 'wording' END,
  CASE WHEN source IN ('src3', 'src5') THEN 'manifest' END], lambda x: x IS NOT NULL) AS signals
FROM documents WHERE regexp_matches(text, '(?i)\\b(decid\\w*|replac\\w*|switch\\w*|migrat\\w*|adopt\\w*|drop\\w*|instead of|introduc\\w*|because|licen[sc]e\\w*)\\b') OR source IN ('src3', 'src5')""")
def decision_candidates(spark, d):
    signals = hi.decision_signals(F.col("text"), F.col("source").isin("src3", "src5"), "licen[sc]e\\w*")
    return table(spark, d, "documents").select("doc_id", signals.alias("signals")).where(F.size("signals") > 0)


_RELEASES = """
WITH t AS (SELECT min(o_orderdate) AS tagged, o_orderpriority AS tag FROM orders GROUP BY o_orderpriority), f AS (SELECT tagged, min(tag) AS tag FROM t GROUP BY tagged)
SELECT o_orderkey, tag AS release FROM orders ASOF LEFT JOIN f ON o_orderdate <= tagged"""


@query("release_notes", _RELEASES)
def release_notes(spark, d):
    """Every order under its release."""
    o = table(spark, d, "orders")
    tags = o.groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("at"))
    return hi.release_groups(o.select("o_orderkey", "o_orderdate"), tags, "o_orderdate", "at", "o_orderpriority").select("o_orderkey", "release")


query("release_notes_all", _RELEASES)(release_notes)
