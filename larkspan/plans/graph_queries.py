"""Graphs derived from ``lineitem``, ``supplier``, ``customer`` and the region hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import graph as gr
from larkspan.plans.registry import query
from larkspan.session import table


def _edges(spark, d, least):
    """Part to the next line's part in one order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = li.where(F.col("l_quantity") >= least).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("s"))
    return a.join(li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("t")), ["l_orderkey", "l_linenumber"]).select("s", "t").distinct()


def _e(least):
    return f"""e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_quantity >= {least})"""


@query("edge_collapse", """
WITH r AS (SELECT l_suppkey, l_partkey % 50 AS target, l_returnflag AS kind, l_orderkey AS line,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50, l_returnflag ORDER BY l_orderkey) AS k FROM lineitem)
SELECT l_suppkey AS source, target, kind, count(*) AS "count", list(line ORDER BY line) FILTER (WHERE k <= 20) AS lines FROM r GROUP BY ALL""")
def edge_collapse(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("line"))
    return gr.collapse(e, ["source", "target", "kind"], "line")


@query("dangling_edges", """
SELECT count(*) FILTER (WHERE l_suppkey <= 90 AND l_partkey <= 1800) AS kept, count(*) FILTER (WHERE NOT (l_suppkey <= 90 AND l_partkey <= 1800)) AS left_out
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def dangling_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t")).distinct()
    ok = (e.join(table(spark, d, "supplier").where("s_suppkey <= 90").select(F.col("s_suppkey").alias("s")), "s", "left_semi")
          .join(table(spark, d, "part").where("p_partkey <= 1800").select(F.col("p_partkey").alias("t")), "t", "left_semi"))
    return e.agg(F.count("*").alias("n")).crossJoin(ok.agg(F.count("*").alias("kept"))).select("kept", (F.col("n") - F.col("kept")).alias("left_out"))


@query("bfs_depths", f"""
WITH RECURSIVE {_e(45)}, w(node, depth) AS (
  SELECT s, 0 FROM (SELECT min(s) AS s FROM e) UNION SELECT t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 12)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bfs_depths(spark, d):
    e = _edges(spark, d, 45)
    return gr.bfs(e, e.select(F.min("s")), "s", "t", 12)


@query("reverse_reach", f"""
WITH RECURSIVE {_e(45)}, w(node, depth) AS (
  SELECT t, 0 FROM (SELECT max(t) AS t FROM e) UNION SELECT s, depth + 1 FROM w JOIN e ON t = node WHERE depth < 3 AND (depth = 0 OR node % 5 <> 0))
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def reverse_reach(spark, d):
    """Bounded reach backwards that stops at tests (parts divisible by five); the start is passed through."""
    e = _edges(spark, d, 45)
    seed = e.select(F.max("t").alias("node"))
    tests = e.select(F.col("s").alias("node")).where("node % 5 = 0").distinct().join(seed, "node", "left_anti")
    return gr.bfs(e, seed, "t", "s", 3, stop_at=tests)


@query("flow_edges", f"""
WITH RECURSIVE {_e(45)}, w(node, depth) AS (
  SELECT s, 0 FROM (SELECT min(s) AS s FROM e) UNION SELECT t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 5),
r AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT hop, caller, callee, place FROM (SELECT depth + 1 AS hop, s AS caller, t AS callee, row_number() OVER (ORDER BY depth + 1, s, t)::INT AS place
  FROM r JOIN e ON s = node) WHERE place <= 60""")
def flow_edges(spark, d):
    e = _edges(spark, d, 45)
    return gr.flow(e, e.agg(F.min("s")).first()[0], "s", "t")


@query("reach_counts", f"""
WITH RECURSIVE {_e(49)}, w(s, t, n) AS (SELECT s, t, 1 FROM e WHERE s <> t UNION SELECT w.s, e.t, n + 1 FROM w JOIN e ON e.s = w.t WHERE n < 4)
SELECT s AS node, count(DISTINCT t) AS reach FROM w WHERE s <> t GROUP BY s""")
def reach_counts(spark, d):
    return gr.reach_counts(_edges(spark, d, 49), "s", "t", 4)


@query("scc_cycles", f"""
WITH RECURSIVE {_e(47)}, w(s, t) AS (SELECT s, t FROM e UNION SELECT w.s, e.t FROM w JOIN e ON e.s = w.t),
m AS (SELECT a.s AS node, b.s AS other FROM w a JOIN w b ON a.t = b.s AND a.s = b.t)
SELECT node, min(least(node, other)) AS component FROM m GROUP BY node""")
def scc_cycles(spark, d):
    return gr.strong_components(_edges(spark, d, 47), "s", "t")


@query("closing_chains", f"""
WITH RECURSIVE {_e(45)}, w AS (
  SELECT s AS a, t AS b, t AS node, [t] AS path FROM e WHERE s <> t
  UNION ALL SELECT a, b, e.t, list_append(path, e.t) FROM w JOIN e ON e.s = w.node AND e.t <> e.s WHERE len(path) <= 5 AND node <> a)
SELECT a AS s, b AS t, path AS chain FROM w WHERE node = a QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1""")
def closing_chains(spark, d):
    """Every edge as one that is added to the others: the shortest way back, of five edges at most."""
    e = _edges(spark, d, 45)
    return gr.closing_chains(e, e, "s", "t", 5)


@query("scc_all_lines")
def scc_all_lines(spark, d):
    """Components of the graph of all lines; recursive SQL does not end on it in time, tests hold it against a plain search."""
    return gr.strong_components(_edges(spark, d, 0), "s", "t")


@query("dead_nodes", f"""
WITH {_e(40)}, n AS (SELECT p_partkey AS node, p_size <= 10 AS is_test FROM part WHERE p_partkey % 3 <> 0),
u AS (SELECT t AS node, bool_and(is_test) AS only_tests FROM e JOIN n ON n.node = e.s WHERE e.s <> e.t GROUP BY t)
SELECT n.node, CASE WHEN only_tests IS NULL THEN 'unused' ELSE 'test_only' END AS verdict FROM n LEFT JOIN u USING (node)
WHERE NOT is_test AND n.node % 10 <> 1 AND (only_tests IS NULL OR only_tests)""")
def dead_nodes(spark, d):
    n = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"), "p_size")
    return gr.dead_nodes(n, _edges(spark, d, 40), "node", "s", "t", F.col("p_size") <= 10, F.col("node") % 10 == 1)


_LAYER = """
l AS (SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'A%' THEN 'ui' WHEN c_mktsegment LIKE '%I%' THEN 'core' WHEN c_nationkey < 10 THEN 'base' END AS layer,
  CASE WHEN c_mktsegment LIKE 'A%' THEN 0 WHEN c_mktsegment LIKE '%I%' THEN 1 WHEN c_nationkey < 10 THEN 2 END AS ordinal FROM customer)"""


def _layers(spark, d):
    rules = spark.createDataFrame([(0, "ui", "^A", 0), (1, "core", "I", 0), (2, "base", "$^", 10)], "ordinal int, layer string, pattern string, nations int")
    return gr.assign_layer(table(spark, d, "customer"), rules, "c_custkey", F.expr("c_mktsegment RLIKE pattern OR c_nationkey < nations"))


@query("layer_assign", f"WITH {_LAYER} SELECT coalesce(layer, 'none') AS layer, count(*) AS n FROM l GROUP BY 1")
def layer_assign(spark, d):
    return _layers(spark, d).groupBy(F.coalesce("layer", F.lit("none")).alias("layer")).agg(F.count("*").alias("n"))


@query("layer_calls", f"""
WITH {_LAYER}, c AS (SELECT o_custkey AS s, (o_custkey * 7 + o_orderkey) % 1500 + 1 AS t FROM orders)
SELECT a.layer AS from_layer, b.layer AS to_layer, CASE WHEN a.ordinal > b.ordinal THEN 'up' ELSE 'down' END AS direction, count(*) AS calls
FROM c JOIN l a ON a.c_custkey = s JOIN l b ON b.c_custkey = t WHERE a.ordinal <> b.ordinal GROUP BY ALL""")
def layer_calls(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("s"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500 + 1).alias("t"))
    return gr.layer_calls(c, _layers(spark, d), "s", "t", "c_custkey")


@query("layer_violations", f"""
WITH {_LAYER}, c AS (SELECT DISTINCT o_custkey AS s, (o_custkey * 7 + o_orderkey) % 1500 + 1 AS t FROM orders)
SELECT s, t FROM c JOIN l a ON a.c_custkey = s JOIN l b ON b.c_custkey = t WHERE a.ordinal > b.ordinal
  AND t IN (SELECT min(c_custkey) FROM customer GROUP BY c_acctbal HAVING count(*) = 1)""")
def layer_violations(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("s"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500 + 1).alias("t")).distinct()
    return gr.layer_violations(c, _layers(spark, d), table(spark, d, "customer"), "s", "t", "c_custkey", "c_acctbal")


_IV = "SELECT DISTINCT l_suppkey AS path, l_linenumber * 40 AS s, l_linenumber * 40 + l_quantity::INT AS e FROM lineitem"


def _intervals(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 40).alias("s"), (F.col("l_linenumber") * 40 + F.col("l_quantity").cast("int")).alias("e")).distinct()


@query("touched_ranges", f"""
WITH i AS ({_IV}), c AS (SELECT DISTINCT ps AS path, ln FROM (SELECT s_suppkey AS ps, (s_suppkey * 13) % 300 AS ln FROM supplier)),
h AS (SELECT i.* FROM i JOIN c ON i.path = c.path AND c.ln BETWEEN i.s AND i.e)
SELECT DISTINCT path, s, e FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.path = a.path AND b.s >= a.s AND b.e <= a.e AND (b.s <> a.s OR b.e <> a.e))""")
def touched_ranges(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), ((F.col("s_suppkey") * 13) % 300).alias("ln")).withColumn("le", F.col("ln"))
    hit = gr.interval_join(_intervals(spark, d), c, "path", ("s", "e"), ("ln", "le")).select("path", "s", "e").distinct()
    return gr.innermost(hit, "path", "s", "e", "s")


@query("interval_overlap_top3", f"""
WITH i AS ({_IV}), c AS (SELECT s_suppkey AS path, (s_suppkey * 13) % 300 AS cs, (s_suppkey * 13) % 300 + 30 AS ce FROM supplier)
SELECT path, cs, s, e, rank FROM (SELECT c.path, cs, s, e, row_number() OVER (PARTITION BY c.path, cs ORDER BY least(e, ce) - greatest(s, cs) DESC, s, e)::INT AS rank
  FROM c JOIN i ON i.path = c.path AND i.s <= ce AND i.e >= cs) WHERE rank <= 3""")
def interval_overlap_top3(spark, d):
    from larkspan.operators.retrieval import top_k

    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), ((F.col("s_suppkey") * 13) % 300).alias("cs")).withColumn("ce", F.col("cs") + 30)
    hit = gr.interval_join(c, _intervals(spark, d), "path", ("cs", "ce"), ("s", "e"))
    return top_k(hit, ["path", "cs"], [(F.least("e", "ce") - F.greatest("s", "cs")).desc(), F.col("s"), F.col("e")], 3).select("path", "cs", "s", "e", "rank")


@query("edge_changes", f"""
WITH {_e(46)}, o AS (SELECT * FROM e WHERE (s + t) % 10 <> 0), n AS (SELECT * FROM e WHERE (s + t) % 10 <> 5)
SELECT s, t, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT s, t, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def edge_changes(spark, d):
    e = _edges(spark, d, 46)
    return gr.edge_changes(e.where("(s + t) % 10 <> 0"), e.where("(s + t) % 10 <> 5"), ["s", "t"])


@query("focus_subgraph", f"""
WITH {_e(40)}, m AS (SELECT min(s) AS n FROM e) SELECT s, t, CASE WHEN s = n AND t = n THEN 'self' WHEN s = n THEN 'out' ELSE 'in' END AS direction FROM e, m WHERE s = n OR t = n""")
def focus_subgraph(spark, d):
    e = _edges(spark, d, 40)
    return gr.focus(e, "s", "t", e.agg(F.min("s")).first()[0])


@query("overlay_graph", f"""
WITH {_e(46)} SELECT s, t, 'indexed' AS origin FROM e WHERE s % 4 <> 0 UNION ALL SELECT DISTINCT s, s + 1, 'working' FROM e WHERE s % 4 = 0""")
def overlay_graph(spark, d):
    e = _edges(spark, d, 46)
    changed = e.where("s % 4 = 0").select("s")
    working = changed.distinct().select("s", (F.col("s") + 1).alias("t"), F.lit("working").alias("origin"))
    return gr.overlay(e.withColumn("origin", F.lit("indexed")), working, changed, "s")


@query("flow_stamps", """
SELECT l_suppkey, substr(sha1(array_to_string(list_sort(list(l_partkey || '=' || l_returnflag)), chr(10))), 1, 12) AS stamp FROM lineitem WHERE l_quantity >= 45 GROUP BY l_suppkey""")
def flow_stamps(spark, d):
    r = table(spark, d, "lineitem").where("l_quantity >= 45").withColumn("l_partkey", F.col("l_partkey").cast("string"))
    return gr.flow_stamp(r, "l_suppkey", "l_partkey", "l_returnflag")


@query("entry_points", f"""
WITH RECURSIVE {_e(49)}, w(s, t, n) AS (SELECT s, t, 1 FROM e WHERE s <> t UNION SELECT w.s, e.t, n + 1 FROM w JOIN e ON e.s = w.t WHERE n < 6),
r AS (SELECT s AS node, count(DISTINCT t) AS reach FROM w WHERE s <> t GROUP BY s),
n AS (SELECT p_partkey AS node FROM part)
SELECT node, coalesce(reach, 0) AS reach, 'declared' AS reason FROM n LEFT JOIN r USING (node) WHERE node % 400 = 1
UNION ALL (SELECT node, reach, 'root' FROM n JOIN r USING (node) WHERE node % 400 <> 1 AND reach >= 3 AND node NOT IN (SELECT t FROM e WHERE s <> t) ORDER BY reach DESC, node LIMIT 40)""")
def entry_points(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return gr.entry_points(_edges(spark, d, 49), n, "node", "s", "t", F.col("node") % 400 == 1)


@query("first_callers", """
WITH e AS (SELECT DISTINCT -o_custkey AS s, l_partkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION
  SELECT a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
w AS (SELECT s, t FROM e UNION SELECT a.s, b.t FROM e a JOIN e b ON b.s = a.t),
r AS (SELECT s AS node, count(*) AS reach FROM w WHERE s <> t GROUP BY s),
n AS (SELECT p_partkey AS node FROM part UNION ALL SELECT -c_custkey FROM customer)
SELECT node, coalesce(reach, 0) AS reach, 'declared' AS reason FROM n LEFT JOIN r USING (node) WHERE node % 400 = 1
UNION ALL (SELECT node, reach, 'root' FROM n JOIN r USING (node) WHERE node % 400 <> 1 AND reach >= 3 AND node NOT IN (SELECT t FROM e WHERE s <> t) ORDER BY reach DESC, node LIMIT 40)""")
def first_callers(spark, d):
    """Entry points of the graph of all lines: customers call the parts they order, a part calls the next of its order; within two calls."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("t"))
    of = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_custkey")).alias("s"))
    e = of.join(li, "l_orderkey").select("s", "t").distinct().union(_edges(spark, d, 0))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node")).union(table(spark, d, "customer").select(-F.col("c_custkey")))
    return gr.entry_points(e, n, "node", "s", "t", F.col("node") % 400 == 1, depth=2)


_REMOVED = """
WITH o AS (SELECT DISTINCT p_brand || '.' || p_type AS name FROM part), n AS (SELECT DISTINCT p_brand || '.' || p_type AS name FROM part WHERE p_type <> 'PROMO'),
g AS (SELECT name, regexp_extract(name, '[^.]*$') AS short FROM (SELECT * FROM o EXCEPT SELECT * FROM n))
SELECT DISTINCT g.name, p_partkey AS site FROM g JOIN part ON p_type = short"""


@query("removed_callers", _REMOVED)
def removed_callers(spark, d):
    """Removed names and the parts that still use them, every part a call site."""
    p = table(spark, d, "part")
    name = F.concat_ws(".", "p_brand", "p_type").alias("name")
    sites = p.select(F.col("p_type").alias("callee"), F.col("p_partkey").alias("site"))
    return gr.removed_callers(p.select(name), p.where("p_type <> 'PROMO'").select(name), sites, "name", "site")


query("removed_callers_all", _REMOVED)(removed_callers)


@query("changed_signatures", """
WITH p AS (SELECT 'f' || (p_partkey // 2) AS name, p_size, p_partkey % 2 AS side FROM part UNION ALL SELECT 'f' || (p_partkey // 2), p_size, 1 FROM part WHERE p_partkey % 14 = 1),
o AS (SELECT name, count(*) AS n, any_value(p_size) AS h FROM p WHERE side = 0 GROUP BY name), n AS (SELECT name, count(*) AS n, any_value(p_size) AS h FROM p WHERE side = 1 GROUP BY name)
SELECT o.name, o.h AS before, n.h AS after FROM o JOIN n USING (name) WHERE o.n = 1 AND n.n = 1 AND o.h <> n.h""")
def changed_signatures(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("f"), F.expr("p_partkey div 2")).alias("name"), "p_size", "p_partkey")
    twice = p.where("p_partkey % 14 = 1")
    return gr.changed_signatures(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1").union(twice), "name", "p_size")


@query("added_dead", """
WITH c AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_quantity >= 48)
SELECT p_partkey AS name FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT name FROM c)""")
def added_dead(spark, d):
    """Parts new to a view (every third) that no line of 48 or more uses."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    used = table(spark, d, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("name")).distinct()
    return gr.added_dead(p.where("name % 3 <> 0"), p, p.join(used, "name", "left_anti"), "name")


@query("stale_marks", """
WITH c AS (SELECT s_suppkey, s_nationkey, s_name FROM supplier WHERE s_suppkey % 9 <> 0),
m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE s_name END AS s_name FROM supplier)
SELECT m.s_suppkey, CASE WHEN c.s_suppkey IS NULL THEN 'missing' WHEN m.s_nationkey IS DISTINCT FROM c.s_nationkey THEN 's_nationkey' ELSE 's_name' END AS status
FROM m LEFT JOIN c USING (s_suppkey) WHERE c.s_suppkey IS NULL OR m.s_nationkey IS DISTINCT FROM c.s_nationkey OR m.s_name IS DISTINCT FROM c.s_name""")
def stale_marks(spark, d):
    s = table(spark, d, "supplier")
    marks = s.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("s_nationkey"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise(F.col("s_name")).alias("s_name"))
    return gr.stale_marks(marks, s.where("s_suppkey % 9 <> 0"), "s_suppkey", ["s_nationkey", "s_name"])


_CHANGED = """CASE doc_id % 12 WHEN 0 THEN 'src/' || source || '/m' || doc_id || '.py' WHEN 1 THEN source || '/requirements-' || lang || '.txt' WHEN 2 THEN '.github/workflows/package.json'
  WHEN 3 THEN 'tests/' || source || '/conftest.py' WHEN 4 THEN 'docs/n' || doc_id || '.md' WHEN 5 THEN 'conftest.py' WHEN 6 THEN 'web/' || lang || '/package.json'
  WHEN 7 THEN 'tests/' || source || '/' || lang || '/test_' || doc_id || '.py' WHEN 8 THEN 'tests/' || source || '/' || lang || '/conftest.py' ELSE 'src/x' || doc_id || '.py' END"""


def _changed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_CHANGED).alias("path"))


@query("run_all_reasons", f"""
WITH c AS (SELECT doc_id, {_CHANGED} AS path FROM documents)
SELECT DISTINCT path, CASE WHEN path LIKE '%/requirements-%' OR path LIKE 'web/%' THEN 'configuration' ELSE 'not analysed' END AS reason FROM c
WHERE path LIKE '%/requirements-%' OR path LIKE 'web/%' OR (path LIKE 'src/%' AND path NOT IN (SELECT path FROM c WHERE doc_id % 5 <> 0))""")
def run_all_reasons(spark, d):
    c = _changed(spark, d)
    return gr.run_all_reasons(c, c.where("doc_id % 5 <> 0"), F.when(F.col("path").startswith("src/"), "code").otherwise("other"))


@query("fixture_tests", f"""
WITH c AS (SELECT doc_id, {_CHANGED} AS path FROM documents), f AS (SELECT DISTINCT path AS fixtures, regexp_replace(path, '/?conftest\\.py$', '') AS folder FROM c WHERE path LIKE '%conftest.py' AND doc_id % 7 <> 0),
t AS (SELECT DISTINCT path FROM c WHERE path LIKE '%/test_%')
SELECT path, arg_max(fixtures, length(folder)) AS fixtures FROM t JOIN f ON folder = '' OR starts_with(path, folder || '/') GROUP BY path""")
def fixture_tests(spark, d):
    c = _changed(spark, d)
    return gr.fixture_tests(c.where("doc_id % 7 <> 0"), c.where("path LIKE '%/test_%'").select("path").distinct())


@query("span_overlaps", """
WITH s AS (SELECT user_id, event_type, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY ALL),
d AS (SELECT user_id, event_type AS kind, epoch_us(ts) AS c, epoch_us(ts) + 600000000 AS e FROM events)
SELECT s.user_id, event_type, kind, count(*) AS near, sum(least(b, e) - greatest(a, c))::BIGINT AS shared_us FROM s JOIN d ON s.user_id = d.user_id AND a <= e AND b >= c GROUP BY ALL""")
def span_overlaps(spark, d):
    """How long the ten minutes after each event lie between a user's first and last event of each type: spans of microseconds to months."""
    ev = table(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    spans = ev.groupBy("user_id", "event_type").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    after = ev.select("user_id", F.col("event_type").alias("kind"), F.col("t").alias("c"), (F.col("t") + 600_000_000).alias("e"))
    hit = gr.interval_join(spans, after, "user_id", ("a", "b"), ("c", "e"))
    shared = F.sum(F.least("b", "e") - F.greatest("a", "c"))
    return hit.groupBy("user_id", "event_type", "kind").agg(F.count("*").alias("near"), shared.alias("shared_us"))
