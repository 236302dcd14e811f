"""Retrieval over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from larkspan.functions import text as tx, vectors as vx
from larkspan.operators import embedding as em, postings, retrieval as rt
from larkspan.operators.store import Store
from larkspan.plans.registry import query
from larkspan.session import scratch_root, table


_TOKENS = r"regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"
_QTERMS = r"""
q0 AS (
  SELECT item_id, text, unnest(ts) AS term, generate_subscripts(ts, 1) AS i
  FROM (SELECT item_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS ts FROM benchmark)
), q1 AS (SELECT item_id, term, min(i) AS i FROM q0 GROUP BY item_id, term),
terms AS (SELECT item_id, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM q1) WHERE k <= 24)
"""
_BM25 = f"""
WITH {_QTERMS},
asked AS (SELECT DISTINCT item_id, term, lower(strip_accents(term)) AS phrase FROM terms),
tok AS (
  SELECT doc_id, {_TOKENS.format(c='source')} AS a, {_TOKENS.format(c='text')} AS b, lang FROM documents
), len AS (SELECT doc_id, lang, len(a) + len(b) AS dl FROM tok),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len),
occ AS (SELECT doc_id, unnest(a) AS t, 3.0 AS w FROM tok UNION ALL SELECT doc_id, unnest(b) AS t, 1.0 AS w FROM tok),
tf AS (SELECT t AS phrase, doc_id, sum(w) AS f FROM occ WHERE t IN (SELECT phrase FROM asked) GROUP BY t, doc_id),
idf AS (SELECT phrase, greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 0) AS raw, avgdl
        FROM (SELECT phrase, count(*) AS n FROM tf GROUP BY phrase), st),
sc AS (
  SELECT item_id, doc_id, lang,
         sum((CASE WHEN raw > 0 THEN raw ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN tf USING (phrase) JOIN idf USING (phrase) JOIN len USING (doc_id) GROUP BY item_id, doc_id, lang
)"""


def _benchmark_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.query_terms(F.col("text")).alias("terms"))


#: Indexes that this process has built, by application and by what they were built from.
_BUILT: dict[tuple, Store] = {}
SHARD_DOCS, BUCKETS = 1280, 8


def _files(spark, d, name):
    """The files of a table as a value: it changes where the table does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.getFileStatus(path).isDirectory() else [fs.getFileStatus(path)]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def index(spark, d):
    """The stored postings index of ``documents`` in the shared folder; built by the first query that asks for it."""
    key = (spark.sparkContext.applicationId, *_files(spark, d, "documents"), *_files(spark, d, "embeddings"))
    if key not in _BUILT:
        store = Store(spark, f"{scratch_root(spark)}/larkspan/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}")
        vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_vector")).distinct()
        docs = table(spark, d, "documents").select("doc_id", "source", "text", "lang").join(vectors, "doc_id", "left")
        postings.update(store, docs, {"source": 3.0, "text": 1.0}, keep=("lang", "has_vector"), shard_docs=SHARD_DOCS, buckets=BUCKETS)
        _BUILT[key] = store
    return _BUILT[key]


def _bm25(spark, d, k, **options):
    """(item_id, doc_id, score, rank): the first ``k`` documents of each benchmark item."""
    hits = postings.search(index(spark, d), _benchmark_terms(spark, d), k, "item_id", **options)
    return hits


def _ranked(hits, k):
    s = hits.withColumn("score", F.round("score", 6))
    return rt.top_k(s, ["item_id"], [F.col("score").desc(), F.col("doc_id")], k)


@query("bm25_topk", _BM25 + """
SELECT item_id, doc_id, score, rank FROM (
  SELECT item_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM sc
) WHERE rank <= 10""")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_filtered_topk", _BM25 + """
SELECT item_id, doc_id, score, rank FROM (
  SELECT item_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM sc WHERE lang = 'en'
) WHERE rank <= 10""")
def bm25_filtered_topk(spark, d):
    return _bm25(spark, d, 10, accept=F.col("lang") == "en").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("keyword_overlap_rank", f"""
WITH {_QTERMS},
s AS (SELECT item_id, doc_id, count(*)::INT AS score FROM terms, documents
      WHERE contains(lower(source || ' ' || text), lower(term)) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s) WHERE rank <= 5""")
def keyword_overlap_rank(spark, d):
    docs = table(spark, d, "documents")
    hits = rt.keyword_overlap(_benchmark_terms(spark, d), docs, F.concat_ws(" ", "source", "text"), "item_id", best=5)
    return rt.top_k(hits, ["item_id"], [F.col("score").desc(), F.col("doc_id").desc()], 5)


@query("keyword_scan", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'that')""")
def keyword_scan(spark, d):
    return rt.keyword_scan(table(spark, d, "documents"), F.col("text"), ["License", "that"]).select("doc_id")


_KNN = """
WITH p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
         (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)"""


@query("knn_cosine", _KNN + """
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 10""")
def knn_cosine(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    hits = rt.knn(q, v, 11, "query_id", "vec_id").where("query_id <> vec_id")
    return rt.top_k(hits, ["query_id"], [F.col("rank")], 10, "place").select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("place").alias("rank"))


_FUSION = _BM25 + """,
lex AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM sc) WHERE k <= 40),
seed AS (SELECT item_id, doc_id AS seed_id FROM (
  SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM sc
  JOIN embeddings ON doc_id = vec_id) WHERE k = 1),
cs AS (
  SELECT s.item_id, b.vec_id AS doc_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
         (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
  FROM seed s JOIN embeddings a ON a.vec_id = s.seed_id, embeddings b
), vec AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM cs) WHERE k <= 40),
vn AS (SELECT item_id, doc_id, score AS vs, CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS vn FROM vec WINDOW w AS (PARTITION BY item_id)),
ln AS (SELECT item_id, doc_id, score AS ls, CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS ln FROM lex WINDOW w AS (PARTITION BY item_id)),
fu AS (
  SELECT item_id, doc_id, CASE WHEN NOT bool_or(ls IS NOT NULL) OVER w THEN vs WHEN NOT bool_or(vs IS NOT NULL) OVER w THEN coalesce(ln, 0)
         ELSE 0.75 * coalesce(vn, 0) + 0.25 * coalesce(ln, 0) END AS score
  FROM vn FULL JOIN ln USING (item_id, doc_id) WINDOW w AS (PARTITION BY item_id)
)"""


@query("hybrid_fusion_topk", _FUSION + """
SELECT item_id, doc_id, score, rank FROM (
  SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM fu
) WHERE rank <= 10""")
def hybrid_fusion_topk(spark, d):
    """Lexical hits of each benchmark item fused with the neighbours of its best document that has a vector."""
    lex = _bm25(spark, d, 40)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    seed = _bm25(spark, d, 1, accept=F.col("has_vector")).join(vectors, "doc_id").select("item_id", "embedding")
    near = rt.knn(seed, vectors, 40, "item_id", "doc_id").select("item_id", "doc_id", "score")
    return _ranked(rt.fuse(near, lex.select("item_id", "doc_id", "score"), ["item_id"], "doc_id"), 10)


@query("group_topk_limits", _BM25 + """
SELECT item_id, lang, doc_id, score, rank FROM (
  SELECT item_id, lang, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY item_id, lang ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM sc
) WHERE rank <= CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 ELSE 2 END""")
def group_topk_limits(spark, d):
    pool = _bm25(spark, d, rt.candidate_pool(5), group="lang").withColumn("score", F.round("score", 6))
    limit = F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).otherwise(2)
    return pool.where(F.col("rank") <= limit).select("item_id", "lang", "doc_id", "score", "rank")


@query("overlay_merge", """
WITH t AS (SELECT doc_id, text, lang,
  (contains(lower(text), 'that'))::INT + (contains(lower(text), 'with'))::INT + (contains(lower(text), 'license'))::INT AS m FROM documents),
live AS (SELECT doc_id, CASE WHEN m = 3 THEN 1.0 ELSE 0.25 * (m / 3.0) END AS score FROM t WHERE doc_id % 10 = 3),
old AS (SELECT doc_id, 0.5 * m / 3.0 AS score FROM t WHERE m > 0 AND doc_id NOT IN (SELECT doc_id FROM live))
SELECT doc_id, round(score, 6) AS score, live FROM (
  SELECT doc_id, score, true AS live FROM live WHERE score > 0 UNION ALL SELECT doc_id, score, false FROM old)""")
def overlay_merge(spark, d):
    docs = table(spark, d, "documents")
    terms = F.array(F.lit("that"), F.lit("with"), F.lit("license"))
    hits = docs.select("doc_id", (0.5 * tx.matched(terms, F.col("text")) / 3.0).alias("score")).where("score > 0")
    out = rt.overlay(hits, docs.where("doc_id % 10 = 3"), terms, F.col("text"), "doc_id")
    return out.select("doc_id", F.round("score", 6).alias("score"), "live")


@query("pinned_exact_first", """
WITH h AS (SELECT doc_id, length(text)::DOUBLE AS score FROM documents WHERE lang = 'de'),
e AS (SELECT doc_id, score FROM h WHERE doc_id % 7 = 0 ORDER BY score DESC, doc_id LIMIT 2)
SELECT doc_id, score, row_number() OVER (ORDER BY tier, score DESC, doc_id)::INT AS place FROM (
  SELECT doc_id, score, 0 AS tier FROM e UNION ALL SELECT doc_id, score, 1 FROM (SELECT * FROM h ORDER BY score DESC, doc_id LIMIT 50)
  WHERE doc_id NOT IN (SELECT doc_id FROM e))""")
def pinned_exact_first(spark, d):
    h = table(spark, d, "documents").where("lang = 'de'").select("doc_id", F.length("text").cast("double").alias("score"))
    best = h.orderBy(F.col("score").desc(), "doc_id").limit(50)
    return rt.pinned(best, h.where("doc_id % 7 = 0"), "doc_id").select("doc_id", "score", "place")


@query("result_rows", """
SELECT doc_id, CASE WHEN length(text) > 240 AND contains(substr(text, 1, 240), chr(10))
  THEN substr(substr(text, 1, 240), 1, 239 - length(regexp_extract(substr(text, 1, 240), '[^\\n]*$')))
  ELSE substr(text, 1, 240) END AS snippet, round(1.0::DOUBLE / (1 + doc_id) + 1e-9, 6) AS score
FROM documents""")
def result_rows(spark, d):
    snippet, score = rt.result_row(F.col("text"), F.lit(1.0) / (1 + F.col("doc_id")) + 1e-9)
    return table(spark, d, "documents").select("doc_id", snippet.alias("snippet"), score.alias("score"))


@query("snippet_windows", """
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b FROM documents),
p AS (SELECT doc_id, b, coalesce(least(nullif(instr(lower(b), 'license'), 0), nullif(instr(lower(b), 'token'), 0)) - 1, 0) AS p0 FROM c),
s AS (SELECT doc_id, b, greatest(0, p0 - 40) AS st FROM p)
SELECT doc_id, (CASE WHEN st > 0 THEN '…' ELSE '' END) || trim(substr(b, (st + 1)::INT, 160)) || (CASE WHEN st + 160 < length(b) THEN '…' ELSE '' END) AS snippet FROM s""")
def snippet_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), F.array(F.lit("license"), F.lit("token"))).alias("snippet"))


@query("vector_quality", """
SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS valid,
  round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label""")
def vector_quality(spark, d):
    v = table(spark, d, "embeddings")
    return v.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(vx.valid(F.col("embedding"), 64).cast("int")).alias("valid"),
        F.round(F.avg(vx.norm(F.col("embedding"))), 6).alias("mean_norm"),
    )


@query("rerank_overlap")
def rerank_overlap(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    hits = _bm25(spark, d, 10).select("item_id", "doc_id").join(items, "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    out = rt.rerank(hits.select("item_id", "query", "doc_id", "text"))
    w = Window.partitionBy("item_id").orderBy(F.col("rerank_score").desc(), "doc_id")
    return out.select("item_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.row_number().over(w).alias("rank"))


@query("embedded_texts")
def embedded_texts(spark, d):
    """Vectors of all conversation turns by the deterministic embedder; tests hold them against a plain version."""
    return em.embed(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text").drop("text")
