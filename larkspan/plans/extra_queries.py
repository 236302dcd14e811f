"""Notes, dependencies, orders and small rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from larkspan.functions import text as tx
from larkspan.operators import code, notes as no
from larkspan.plans.registry import query
from larkspan.session import table
from larkspan.sources import documents as ds

_LINES = "l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


@query("note_units", f"""
WITH {_LINES}, u AS (SELECT *, sum((regexp_matches(line, '^(Th|An|En)'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM l)
SELECT doc_id, unit::BIGINT AS unit, min(pos)::INT AS start, count(*) AS n FROM u GROUP BY doc_id, unit""")
def note_units(spark, d):
    lines = _lines(spark, d).withColumn("line", F.when(F.col("line").rlike("^(Th|An|En)"), F.concat(F.lit("- "), "line")).otherwise(F.concat(F.lit("x"), "line")))
    return no.units(lines, ["doc_id"], "pos", "line").select("doc_id", "unit", "start", F.size("lines").cast("long").alias("n"))


@query("unit_scores", """
SELECT doc_id, (contains(lower(text), 'that')::INT + contains(lower(text), 'license')::INT + contains(lower(string_split(text, chr(10))[1]), 'that')::INT + contains(lower(string_split(text, chr(10))[1]), 'license')::INT) AS score FROM documents""")
def unit_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", no.unit_score(F.split("text", "\n"), F.array(F.lit("that"), F.lit("license"))).alias("score"))


@query("focus_terms", f"""
WITH w AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM benchmark)),
f AS (SELECT item_id, w, min(i) AS i FROM w WHERE w NOT IN ({", ".join(f"'{w}'" for w in tx.STOPWORDS)}) GROUP BY item_id, w),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f)
SELECT item_id, list(w ORDER BY k) AS terms FROM k WHERE k <= 24 GROUP BY item_id""")
def focus_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.focus_terms(F.col("text")).alias("terms"))


@query("evidence_windows", """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, pos AS "start", pos + 2 AS "end", contains(lower(line), 'that')::INT + contains(lower(line), 'with')::INT AS score FROM l),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "start") AS k FROM w WHERE score > 0), f AS (SELECT * FROM a WHERE k = 1),
b AS (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.score DESC, a."start") AS j FROM a JOIN f USING (doc_id) WHERE a."start" > f."end" OR a."end" < f."start")
SELECT doc_id, 1::INT AS place, "start", "end", score::BIGINT AS score FROM f UNION ALL SELECT doc_id, 2, "start", "end", score FROM b WHERE j = 1""")
def evidence_windows(spark, d):
    terms = F.array(F.lit("that"), F.lit("with"))
    w = _lines(spark, d).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"), tx.matched(terms, F.col("line")).alias("score")).where("score > 0")
    return no.evidence_windows(w, ["doc_id"], "start", "end", "score")


@query("clipped_citations", """
WITH c AS (SELECT doc_id, greatest(doc_id % 20 - 3, 1) AS a, least(doc_id % 20 + 4, len(string_split(text, chr(10)))) AS b FROM documents)
SELECT doc_id, a AS first, b AS last FROM c WHERE a <= b""")
def clipped_citations(spark, d):
    a, b, ok = no.clip(F.col("doc_id") % 20 - 3, F.col("doc_id") % 20 + 4, F.size(F.split("text", "\n")).cast("long"))
    return table(spark, d, "documents").where(ok).select("doc_id", a.alias("first"), b.alias("last"))


@query("top_hunks", """
WITH t AS (SELECT l_suppkey, sum(l_quantity) AS t FROM lineitem GROUP BY l_suppkey ORDER BY t DESC, l_suppkey LIMIT 5),
h AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, sum(l_quantity) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT h.*, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, pos) AS k FROM h JOIN t USING (l_suppkey))
SELECT l_suppkey, pos, row_number() OVER (PARTITION BY l_suppkey ORDER BY pos)::INT AS place FROM r WHERE k <= 4""")
def top_hunks(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).agg(F.sum("l_quantity").alias("score"))
    return no.top_hunks(h, "l_suppkey", "pos", "score", 5, 4).select("l_suppkey", "pos", "place")


@query("code_first_order", """
WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'doc' WHEN doc_id % 5 = 1 THEN 'test' ELSE 'code' END AS kind, n_chars FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, kind ORDER BY n_chars DESC, doc_id) AS rn FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN kind <> 'code' AND rn = 1 THEN 0 WHEN kind = 'code' THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS ch FROM k)
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN kind = 'code' THEN 0 ELSE 1 END, n_chars DESC, doc_id)::INT AS place FROM c WHERE ch <= 8""")
def code_first_order(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "doc").when(F.col("doc_id") % 5 == 1, "test").otherwise("code")
    return no.code_first(table(spark, d, "documents").withColumn("kind", kind), ["lang"], "kind", "n_chars", "doc_id", 8).select("lang", "doc_id", "place")


@query("test_order", """
SELECT p_partkey, row_number() OVER (ORDER BY (p_size > 45) DESC, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 7 END NULLS LAST, (p_partkey % 2 = 0) DESC, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 11 END NULLS LAST, p_partkey)::INT AS place FROM part""")
def test_order(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.when(k % 3 != 0, k % 7).alias("hops"), F.when(k % 5 != 0, k % 11).alias("depth"))
    return no.test_order(rows, F.col("p_size") > 45, "hops", k % 2 == 0, "depth", "p_partkey").select("p_partkey", "place")


@query("deepest_project", """
WITH i AS (SELECT doc_id, 'w/' || lang || '/' || source || '/d' || doc_id AS path FROM documents), p AS (SELECT 'w' AS root UNION ALL SELECT DISTINCT 'w/' || lang FROM documents WHERE lang <> 'fr' UNION ALL SELECT DISTINCT 'w/' || lang || '/' || source FROM documents WHERE source IN ('src1', 'src2'))
SELECT doc_id, (SELECT max(root) FROM p WHERE path = root OR starts_with(path, root || '/')) AS root FROM i""")
def deepest_project(spark, d):
    docs = table(spark, d, "documents")
    i = docs.select("doc_id", F.concat_ws("/", F.lit("w"), "lang", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("path"))
    p = docs.select(F.lit("w").alias("root")).union(docs.where("lang <> 'fr'").select(F.concat_ws("/", F.lit("w"), "lang"))).union(docs.where("source IN ('src1', 'src2')").select(F.concat_ws("/", F.lit("w"), "lang", "source"))).distinct()
    return code.deepest_project(i, p, "path", "root").select("doc_id", "root")


@query("locked_versions", """
WITH dep AS (SELECT DISTINCT p_brand AS name, '^' || (p_size % 3 + 1) || '.0' AS specifier FROM part), lock AS (SELECT DISTINCT p_brand AS name, p_size % 5 AS major, p_size % 10 AS minor FROM part)
SELECT dep.name, specifier, (SELECT l.major || '.' || l.minor FROM lock l WHERE l.name = dep.name AND l.major = specifier[2]::INT ORDER BY l.minor DESC LIMIT 1) AS version FROM dep""")
def locked_versions(spark, d):
    p = table(spark, d, "part")
    deps = p.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat(F.lit("^"), (F.col("p_size") % 3 + 1).cast("string"), F.lit(".0")).alias("specifier")).distinct()
    lock = p.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 10).cast("string")).alias("version")).distinct()
    return code.locked_versions(deps, lock).select("name", "specifier", "version")


@query("advisory_cache", """
WITH dep AS (SELECT s_suppkey, 'v' || s_suppkey AS version FROM supplier), c AS (SELECT s_suppkey, TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 1 HOUR * (s_suppkey % 12) AS at FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT s_suppkey, s_suppkey IN (SELECT s_suppkey FROM c WHERE at >= TIMESTAMP '2024-01-01 18:00:00') AS known FROM dep""".replace(" AS at ", " AS seen ").replace("WHERE at", "WHERE seen"))
def advisory_cache(spark, d):
    s = table(spark, d, "supplier")
    deps = s.select("s_suppkey", F.lit("npm").alias("ecosystem"), F.col("s_name").alias("name"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("version"))
    at = F.to_timestamp(F.lit("2024-01-02 00:00:00")) - F.make_dt_interval(hours=(F.col("s_suppkey") % 12).cast("int"))
    cache = deps.where("s_suppkey % 3 <> 0").select("ecosystem", "name", "version", at.alias("checked_at"))
    known, ask = code.advisories(deps, cache, F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    return known.select("s_suppkey", F.lit(True).alias("known")).union(ask.select("s_suppkey", F.lit(False)))


@query("report_changes", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'new' WHEN s_suppkey % 4 = 1 THEN 'resolved' ELSE 'same' END AS state FROM supplier""")
def report_changes(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    return code.report_changes(s.where("s_suppkey % 4 <> 0"), s.where("s_suppkey % 4 <> 1"), "s_suppkey")


@query("orphan_candidates", """
WITH p AS (SELECT a.vec_id AS fn, b.vec_id AS feature, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 7 AND b.vec_id % 50 = 3)
SELECT fn, feature, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY round(s, 6) DESC, feature)::INT AS rank FROM p) WHERE rank <= 2""")
def orphan_candidates(spark, d):
    v = table(spark, d, "embeddings")
    out = code.orphan_candidates(v.where("vec_id % 20 = 7").withColumnRenamed("vec_id", "fn"), v.where("vec_id % 50 = 3").withColumnRenamed("vec_id", "feature"), "fn", "feature")
    return out.select("fn", "feature", F.round("score", 6).alias("score"), "rank")


@query("name_collisions", "SELECT p_name, count(*) AS n, sum(length(p_type))::BIGINT AS budget FROM part GROUP BY p_name HAVING count(*) > 1")
def name_collisions(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.sum(F.length("p_type")).alias("budget")).where("n > 1")


@query("site_memory_today", """
WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS matches FROM events GROUP BY ALL)
SELECT day, event_type, matches FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY matches DESC, event_type) AS rn FROM n) WHERE rn <= 2""")
def site_memory_today(spark, d):
    n = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("matches"))
    return n.withColumn("_rn", F.row_number().over(Window.partitionBy("day").orderBy(F.col("matches").desc(), "event_type"))).where("_rn <= 2").drop("_rn")


@query("pause_clamp", "SELECT event_id, least(greatest(value, 30), 3600)::DOUBLE AS pause FROM events")
def pause_clamp(spark, d):
    return table(spark, d, "events").select("event_id", no.pause_seconds(F.col("value")).cast("double").alias("pause"))


@query("percent_cut", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l_discount * 100)::INT AS percent FROM lineitem")
def percent_cut(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", no.percent(F.col("l_discount")).alias("percent"))


@query("nulls_last_page", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id LIMIT 50 OFFSET 100")
def nulls_last_page(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")
    return rows.orderBy(F.col("quality").asc_nulls_last(), "doc_id").offset(100).limit(50)


@query("exact_id_first", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id = 77 THEN 0 ELSE 1 END, n_chars DESC, doc_id)::INT AS place FROM documents QUALIFY place <= 20")
def exact_id_first(spark, d):
    order = [F.when(F.col("doc_id") == 77, 0).otherwise(1), F.col("n_chars").desc(), F.col("doc_id")]
    best = table(spark, d, "documents").orderBy(*order).limit(20)
    return best.select("doc_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("routes", """
SELECT CASE WHEN regexp_matches(text, '(?i)\\bsite:|^https?://') THEN 'web' WHEN regexp_matches(text, '(?i)\\b(cve|vulnerab|security advis)') THEN 'advisories'
  WHEN regexp_matches(text, '\\.(py|js|ts|go|java)\\b|\\w+\\(\\)|_\\w+') THEN 'code' ELSE 'documents' END AS route, count(*) AS n FROM conversations GROUP BY 1""")
def routes(spark, d):
    return table(spark, d, "conversations").groupBy(no.route(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


@query("text_stamps", """
SELECT doc_id, substr(sha1(regexp_replace(text, '\\s', '', 'g')), 1, 12) AS stamp, lower(trim(regexp_replace(substr(text, 1, 40), '\\s+', ' ', 'g'))) AS query FROM documents""")
def text_stamps(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.stamp(F.col("text")).alias("stamp"), tx.normalise_query(F.substring("text", 1, 40)).alias("query"))


@query("location_kinds", "SELECT CASE p_size % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'slide' WHEN 2 THEN 'part' ELSE 'source_line' END AS kind, count(*) AS n FROM part GROUP BY 1")
def location_kinds(spark, d):
    ext = F.get(F.array(F.lit("pdf"), F.lit("PPTX"), F.lit("html"), F.lit("py")), F.col("p_size") % 4)
    return table(spark, d, "part").groupBy(ds.location_kind(F.concat(F.lit("a/b."), ext)).alias("kind")).agg(F.count("*").alias("n"))


@query("reduced_versions", "SELECT p_partkey, (p_size % 9) || '.' || (p_size % 4) AS version FROM part")
def reduced_versions(spark, d):
    v = F.concat_ws(".", (F.col("p_size") % 9).cast("string"), (F.col("p_size") % 4).cast("string"))
    spec = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("^"), v)).otherwise(F.concat(F.lit(">="), v, F.lit(" <99")))
    return table(spark, d, "part").select("p_partkey", ds.reduced_version(F.lit("npm"), spec).alias("version"))


@query("reference_edges")
def reference_edges(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return code.reference_edges(pages).groupBy("kind", "resolution").agg(F.count("*").alias("n"))
