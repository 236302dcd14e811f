"""Web results over ``pages``, ``documents`` and ``benchmark``; a page's tier is page_id modulo 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import text as tx, urls
from larkspan.operators import web, windows as wi
from larkspan.plans.registry import query
from larkspan.session import table
from larkspan.sources import corpus, documents as ds


def _pages(spark, d):
    return table(spark, d, "pages")


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


@query("site_filter", f"SELECT page_id, {_HOST} AS host FROM pages WHERE regexp_matches({_HOST}, '(^|\\.)(site1|site2)\\.[a-z]+$') OR {_HOST} LIKE 'm.%'")
def site_filter(spark, d):
    h = urls.host(F.col("url"))
    return _pages(spark, d).select("page_id", h.alias("host")).where(F.col("host").rlike("(^|\\.)(site1|site2)\\.[a-z]+$") | F.col("host").startswith("m."))


@query("site_subdomains", f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), b AS (SELECT regexp_extract(min(host), '[^.]+\\.[^.]+$') AS d FROM h)
SELECT page_id FROM h, b WHERE host = d OR host LIKE '%.' || d""")
def site_subdomains(spark, d):
    p = _pages(spark, d)
    base = p.select(F.regexp_extract(F.min(urls.host(F.col("url"))), "[^.]+\\.[^.]+$", 0)).first()[0]
    return p.where(urls.on_sites(F.col("url"), [base])).select("page_id")


@query("url_normalize", "SELECT regexp_replace(url, '#.*$', '') AS url, count(*) AS n FROM pages GROUP BY 1")
def url_normalize(spark, d):
    return _pages(spark, d).groupBy(urls.normalise(F.col("url")).alias("url")).agg(F.count("*").alias("n"))


@query("sites_asked", """
SELECT item_id, ['a.example', 'b' || item_id || '.org'] AS sites FROM benchmark""")
def sites_asked(spark, d):
    q = F.concat(F.lit("site:a.example what site:b"), F.col("item_id").cast("string"), F.lit(".org site:a.example"))
    return table(spark, d, "benchmark").select("item_id", urls.sites_asked(q).alias("sites"))


_MERGED = """
WITH r AS (SELECT page_id % 5 AS query, page_id % 3 AS tier, page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'u' || (page_id % 40) END AS url FROM pages),
t AS (SELECT *, row_number() OVER (PARTITION BY query, tier ORDER BY page_id) AS turn FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY turn, tier) AS seen FROM t)
SELECT query, page_id, place FROM (SELECT query, page_id, row_number() OVER (PARTITION BY query ORDER BY turn, tier)::INT AS place FROM s WHERE seen = 1 OR url = '') """


def _results(spark, d):
    return _pages(spark, d).select(
        (F.col("page_id") % 5).alias("query"), (F.col("page_id") % 3).alias("tier"), "page_id",
        F.when(F.col("page_id") % 11 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("page_id") % 40).cast("string"))).alias("url"))


@query("round_robin_merge", _MERGED + "WHERE place <= 20")
def round_robin_merge(spark, d):
    return wi.interleave(_results(spark, d), ["query"], F.col("tier"), "page_id", F.col("tier"), "url", 20).select("query", "page_id", "place")


@query("zip_merge", _MERGED.replace("% 3", "% 2") + "WHERE place <= 10")
def zip_merge(spark, d):
    r = _results(spark, d).withColumn("tier", F.col("page_id") % 2)
    return wi.interleave(r, ["query"], F.col("tier"), "page_id", F.col("tier"), "url", 10).select("query", "page_id", "place")


@query("federated_tiers", """
SELECT tier, count(*) AS n FROM (SELECT 'alpha' AS tier, page_id FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'beta', page_id FROM pages WHERE page_id % 3 = 1) GROUP BY tier""")
def federated_tiers(spark, d):
    p = _pages(spark, d)
    return web.federate({"alpha": p.where("page_id % 3 = 0"), "beta": p.where("page_id % 3 = 1")}).groupBy("tier").agg(F.count("*").alias("n"))


@query("ttl_freshness", """
WITH v AS (SELECT *, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' WHEN 'signup' THEN 'low' END AS volatility FROM events),
a AS (SELECT volatility, epoch(TIMESTAMP '2024-01-30 00:00:00' - date_trunc('second', ts))::BIGINT AS age FROM v)
SELECT coalesce(volatility, 'unknown') AS volatility, count(*) FILTER (WHERE age <= CASE volatility WHEN 'medium' THEN 86400 WHEN 'low' THEN 604800 ELSE 0 END AND age <= 2592000) AS fresh, count(*) AS entries FROM a GROUP BY 1""")
def ttl_freshness(spark, d):
    v = F.when(F.col("event_type") == "click", "high").when(F.col("event_type") == "view", "medium").when(F.col("event_type") == "signup", "low")
    e = table(spark, d, "events").withColumn("volatility", v)
    ok = web.fresh(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-30 00:00:00")), F.col("volatility"))
    return e.groupBy(F.coalesce("volatility", F.lit("unknown")).alias("volatility")).agg(F.sum(F.coalesce(ok, F.lit(False)).cast("int")).alias("fresh"), F.count("*").alias("entries"))


@query("cache_match_priority", """
WITH c AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents),
q AS (SELECT doc_id AS q, n FROM c WHERE doc_id % 7 = 0), k AS (SELECT doc_id, n FROM c WHERE doc_id % 7 <> 0),
e AS (SELECT q, min(doc_id) AS doc_id FROM q JOIN k USING (n) GROUP BY q),
s AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rn FROM (SELECT a.doc_id AS q, b.doc_id, 1 - abs(a.n_chars - b.n_chars) / 100.0 AS score FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source WHERE a.doc_id % 7 = 0 AND b.doc_id % 7 <> 0) WHERE score >= 0.45 AND q NOT IN (SELECT q FROM e))
SELECT q, doc_id, 'exact' AS how FROM e UNION ALL SELECT q, doc_id, 'semantic' FROM s WHERE rn = 1""")
def cache_match_priority(spark, d):
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "q")
    k = docs.where("doc_id % 7 <> 0")
    near = q.alias("a").join(k.alias("b"), ["lang", "source"]).select("q", "doc_id", (1 - F.abs(F.col("a.n_chars") - F.col("b.n_chars")) / 100.0).alias("score"))
    return web.cache_match(q, k, "q", "text", "doc_id", near, 0.45)


@query("result_sufficiency", f"""
SELECT page_id % 20 AS query, count(*) AS rows, count(*) FILTER (WHERE page_id % 3 <> 0) AS with_snippet, count(DISTINCT {_HOST}) AS domains,
  count(*) >= 5 AND 2 * count(*) FILTER (WHERE page_id % 3 <> 0) >= count(*) AND count(DISTINCT {_HOST}) >= 3 AS enough FROM pages GROUP BY 1""")
def result_sufficiency(spark, d):
    p = _pages(spark, d).select((F.col("page_id") % 20).alias("query"), "url", F.when(F.col("page_id") % 3 != 0, "text").otherwise(" ").alias("snippet"))
    return web.sufficiency(p, ["query"], "snippet", "url")


@query("new_urls_per_round", """
WITH f AS (SELECT page_id % 3 AS query, page_id % 30 AS url, min(page_id // 60) AS r FROM pages GROUP BY ALL) SELECT query, r AS round, count(*) AS "new" FROM f GROUP BY query, r""")
def new_urls_per_round(spark, d):
    p = _pages(spark, d).select((F.col("page_id") % 3).alias("query"), (F.col("page_id") % 30).alias("url"), F.expr("page_id div 60").alias("r"))
    return web.new_per_round(p, ["query"], "r", "url")


@query("evidence_first", """
WITH b AS (SELECT page_id % 4 AS query, page_id % 25 AS url, page_id AS rank, CASE WHEN page_id % 9 = 0 THEN 0 ELSE 1 END AS s FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY s, rank) AS rn FROM b)
SELECT query, url, place FROM (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY s, rank, url)::INT AS place FROM k WHERE rn = 1) WHERE place <= 10""")
def evidence_first(spark, d):
    p = _pages(spark, d).select((F.col("page_id") % 4).alias("query"), (F.col("page_id") % 25).alias("url"), F.col("page_id").alias("rank"))
    p = p.withColumn("url", F.col("url").cast("string"))
    out = web.evidence_first(p.where("rank % 9 = 0"), p.where("rank % 9 <> 0"), ["query"], "url", "rank", 10)
    return out.withColumn("url", F.col("url").cast("long"))


@query("volatility_annotation", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'low' ELSE 'medium' END AS volatility FROM pages""")
def volatility_annotation(spark, d):
    p = _pages(spark, d)
    items = p.where("page_id % 4 = 0").select("page_id", F.lit("low").alias("volatility"))
    return web.annotate(p.select("page_id"), items, "page_id", F.lit("medium"))


@query("thin_pages", """
SELECT doc_id FROM documents WHERE length(trim(text)) < 1500 OR (length(trim(text)) < 5000 AND (contains(lower(substr(trim(text), 1, 600)), 'loading...') OR contains(lower(substr(trim(text), 1, 600)), 'enable javascript')))""")
def thin_pages(spark, d):
    return table(spark, d, "documents").where(web.thin(F.col("text"))).select("doc_id")


@query("page_links", """
SELECT page_id, link, CASE WHEN regexp_matches(link, '^(https?:)?//|^mailto:') THEN 'external' WHEN link LIKE '#%' THEN 'anchor' ELSE 'local' END AS kind
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)["'']', 1)) AS link FROM pages)""")
def page_links(spark, d):
    links = _pages(spark, d).select("page_id", F.explode(web.html_links(F.col("html"))).alias("link"))
    return links.withColumn("kind", web.link_kind(F.col("link")))


@query("broken_links", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)["'']', 1)) AS path FROM pages),
p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM l WHERE path LIKE '/%' AND path NOT IN (SELECT path FROM p)""")
def broken_links(spark, d):
    p = _pages(spark, d)
    links = p.select("page_id", F.explode(web.html_links(F.col("html"))).alias("path")).where(F.col("path").startswith("/"))
    known = p.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return web.broken_links(links, known, "path", "path").select("page_id", "path")


@query("page_cache", """
WITH p AS (SELECT regexp_replace(url, '#.*$', '') AS u, page_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (page_id % 48) AS saved FROM pages)
SELECT a.page_id AS asked, (SELECT b.page_id FROM p b WHERE b.u = a.u AND b.saved >= TIMESTAMP '2024-01-01 23:00:00' ORDER BY saved DESC LIMIT 1) AS page_id FROM p a""")
def page_cache(spark, d):
    p = _pages(spark, d).select("url", "page_id", (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=(F.col("page_id") % 48).cast("int"))).alias("saved"))
    return web.cached_pages(p.select(F.col("page_id").alias("asked"), "url"), p, "url", "saved", F.to_timestamp(F.lit("2024-01-02 23:00:00"))).select("asked", "page_id")


@query("read_many", """
WITH a AS (SELECT page_id % 6 AS request, page_id AS o, CASE WHEN page_id % 10 = 9 THEN 'ftp://x/' || page_id WHEN page_id % 10 = 8 THEN 'https://none/' || (page_id % 20) ELSE url END AS url FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY request, url ORDER BY o) AS rn FROM a),
k AS (SELECT request, url, row_number() OVER (PARTITION BY request ORDER BY o)::INT AS place FROM f WHERE rn = 1)
SELECT request, place, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'not a web address' WHEN url NOT IN (SELECT url FROM pages) THEN 'not found' END AS error FROM k WHERE place <= 8""")
def read_many(spark, d):
    p = _pages(spark, d)
    u = F.when(F.col("page_id") % 10 == 9, F.concat(F.lit("ftp://x/"), F.col("page_id").cast("string"))).when(
        F.col("page_id") % 10 == 8, F.concat(F.lit("https://none/"), (F.col("page_id") % 20).cast("string"))).otherwise(F.col("url"))
    asked = p.select((F.col("page_id") % 6).alias("request"), F.col("page_id").alias("o"), u.alias("url"))
    return web.read_many(asked, p.select("url", "html").dropDuplicates(["url"]), ["request"], "url", "o").select("request", "place", "error")


@query("html_blocks")
def html_blocks(spark, d):
    blocks = corpus.explode_files(_pages(spark, d), lambda h: [(i, b) for i, b in enumerate(ds.html_blocks(h))], "page_id", "html", "place int, block string")
    return blocks.select("page_id", "place", "block")


@query("piece_selection")
def piece_selection(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 6000")
    pieces = corpus.explode_files(docs, lambda t: [(i, p) for i, p in enumerate(corpus.split_text(t))], "doc_id", "text", "place long, piece string")
    terms = F.array(F.lit("that"), F.lit("with"))
    scored = pieces.select("doc_id", "place", tx.matched(terms, F.col("piece")).alias("score"), F.length("piece").cast("long").alias("size"))
    return web.select_pieces(scored, ["doc_id"], "place", "score", "size", 5000)


@query("parts_fold")
def parts_fold(spark, d):
    def parts(t):
        return [(i, len(p), sum(map(len, p))) for i, p in enumerate(corpus.group_parts(t.split("\n")))]

    return corpus.explode_files(table(spark, d, "documents"), parts, "doc_id", "text", "part int, blocks int, chars int")


@query("query_intent", r"""
WITH q AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'npm install ' || regexp_extract(text, '[A-Za-z]+') || ' CVE-2024-' || item_id WHEN 1 THEN 'Is @scope/pkg' || item_id || ' safe' WHEN 2 THEN 'npm ' || text ELSE text || ' security advisories' END AS q FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(lower(q), '@[a-z0-9][\w.-]*/[a-z0-9]') THEN regexp_extract(lower(q), '(@[a-z0-9][\w.-]*/[a-z0-9][\w.-]*)', 1)
  ELSE nullif(regexp_extract(lower(q), '\bnpm\s+(?:install\s+|i\s+|package\s+|module\s+)?([a-z0-9][a-z0-9._-]*)', 1), '') END AS package,
  regexp_matches(lower(q), '\bcve-[0-9]{4}-[0-9]+|\b(?:security|vulnerab\w*|advisor(?:y|ies)|exploit\w*)\b') AS security FROM q""")
def query_intent(spark, d):
    i = F.col("item_id")
    q = (
        F.when(i % 5 == 0, F.concat(F.lit("npm install "), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(" CVE-2024-"), i.cast("string")))
        .when(i % 5 == 1, F.concat(F.lit("Is @scope/pkg"), i.cast("string"), F.lit(" safe"))).when(i % 5 == 2, F.concat(F.lit("npm "), "text"))
        .otherwise(F.concat("text", F.lit(" security advisories")))
    )
    package, security = web.query_intent(q)
    return table(spark, d, "benchmark").select("item_id", package.alias("package"), security.alias("security"))


@query("deep_crawl", """
WITH r AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, least(n_chars, 30000 - before)::BIGINT AS taken FROM r WHERE 30000 - before > 0 AND n_chars > 0""")
def deep_crawl(spark, d):
    pages = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return web.crawl(pages, ["source"], "doc_id", "n_chars", 30000).select("source", "doc_id", "taken")
