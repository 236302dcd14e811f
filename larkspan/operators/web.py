"""Federated results and page caches: merging, freshness, matching, sufficiency, piece selection, link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.functions import text as tx, urls

# Fixed value: seconds that an answer stays fresh, by how fast its subject changes.
TTL = {"high": 0, "medium": 86_400, "low": 604_800}
MAX_AGE = 30 * 86_400
THIN_CHARS, PLACEHOLDER_CHARS = 1500, 5000
# Fixed value: what a page says that has not been rendered.
PLACEHOLDERS = ("carregando", "loading...", "enable javascript", "habilite o javascript", "ative o javascript")


def federate(tiers: dict[str, DataFrame]) -> DataFrame:
    """One table of the tiers' results, each row marked with its tier."""
    out = None
    for name, df in tiers.items():
        part = df.withColumn("tier", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def keep_first(rows: DataFrame, by: list[str], url: str, order: list[Column]) -> DataFrame:
    """Rows without later repeats of a url; rows without one all stay."""
    w = Window.partitionBy(*by, url).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | F.col(url).isNull() | (F.col(url) == "")).drop("_rn")


def ttl(volatility: Column) -> Column:
    """Seconds to live; an unknown volatility counts as high."""
    out = F.lit(TTL["high"])
    for k, v in TTL.items():
        out = F.when(volatility == k, v).otherwise(out)
    return out


def fresh(saved: Column, now: Column, volatility: Column) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(saved)
    return (age <= ttl(volatility)) & (age <= MAX_AGE)


def cache_match(queries: DataFrame, cache: DataFrame, query: str, text: str, key: str, similarity: DataFrame, least: float) -> DataFrame:
    """(query, key, how): the cached entry of the same normalised query; else the most similar of at least ``least``.

    ``similarity`` has (query, key, score); it is only asked where no exact entry is.
    """
    norm = tx.normalise_query
    exact = queries.select(query, norm(F.col(text)).alias("_n")).join(cache.select(key, norm(F.col(text)).alias("_n")), "_n")
    exact = exact.groupBy(query).agg(F.min(key).alias(key)).withColumn("how", F.lit("exact"))
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    near = similarity.where(F.col("score") >= least).join(exact.select(query), query, "left_anti").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return exact.union(near.select(query, key, F.lit("semantic").alias("how")))


def sufficiency(rows: DataFrame, by: list[str], snippet: str, url: str, least: int = 5, domains: int = 3) -> DataFrame:
    """Whether a result list is enough: rows, half of them with a snippet, distinct domains."""
    host = F.coalesce(urls.host(F.col(url)), F.lit(""))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum((F.length(F.trim(F.coalesce(snippet, F.lit("")))) > 0).cast("int")).alias("with_snippet"), F.countDistinct(host).alias("domains"))
    return out.withColumn("enough", (F.col("rows") >= least) & (2 * F.col("with_snippet") >= F.col("rows")) & (F.col("domains") >= domains))


def new_per_round(rows: DataFrame, by: list[str], round_: str, url: str) -> DataFrame:
    """(by, round, new): urls first seen in each round."""
    first = rows.groupBy(*by, url).agg(F.min(round_).alias("_first"))
    return first.groupBy(*by, F.col("_first").alias("round")).agg(F.count("*").alias("new"))


def evidence_first(evidence: DataFrame, results: DataFrame, by: list[str], url: str, rank: str, limit: int) -> DataFrame:
    """Evidence rows before results, no url twice, ``limit`` rows at most."""
    both = evidence.select(*by, url, rank, F.lit(0).alias("_s")).union(results.select(*by, url, rank, F.lit(1).alias("_s")))
    kept = keep_first(both, by, url, [F.col("_s"), F.col(rank)])
    w = Window.partitionBy(*by).orderBy("_s", rank, url)
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(*by, url, "place")


def annotate(rows: DataFrame, items: DataFrame, url: str, overall: Column) -> DataFrame:
    """``rows`` with ``volatility``: that of the url, else the overall one."""
    return rows.join(items.select(url, F.col("volatility").alias("_v")), url, "left").withColumn("volatility", F.coalesce("_v", overall)).drop("_v")


def thin(text: Column) -> Column:
    """A page with too little text to be what was asked for, or with a placeholder at its start."""
    t = F.trim(text)
    head = F.lower(F.substring(t, 1, 600))
    waiting = F.lit(False)
    for p in PLACEHOLDERS:
        waiting = waiting | F.contains(head, F.lit(p))
    return (F.length(t) < THIN_CHARS) | ((F.length(t) < PLACEHOLDER_CHARS) & waiting)


def cached_pages(asked: DataFrame, pages: DataFrame, url: str, saved: str, now: Column, hours: int = 24) -> DataFrame:
    """Asked urls with the page read within ``hours``, matched by their normal form; null where it must be read."""
    p = pages.select(urls.normalise(F.col(url)).alias("_u"), F.col(saved).alias("_at"), *[c for c in pages.columns if c not in (url, saved)])
    p = p.where(F.unix_timestamp(now) - F.unix_timestamp("_at") <= hours * 3600)
    newest = Window.partitionBy("_u").orderBy(F.col("_at").desc())
    p = p.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    return asked.withColumn("_u", urls.normalise(F.col(url))).join(p, "_u", "left").withColumnRenamed("_at", saved).drop("_u")


def read_many(asked: DataFrame, pages: DataFrame, by: list[str], url: str, order: str, most: int = 8) -> DataFrame:
    """The first ``most`` distinct urls of each request in order, each with its page or an error."""
    w = Window.partitionBy(*by).orderBy(order)
    once = keep_first(asked, by, url, [F.col(order)]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    out = once.join(pages.withColumn("_there", F.lit(True)), url, "left")
    bad = ~F.col(url).rlike("^https?://")
    return out.withColumn("error", F.when(bad, "not a web address").when(F.col("_there").isNull(), "not found")).drop("_there")


def select_pieces(pieces: DataFrame, by: list[str], place: str, score: str, size: str, budget: int) -> DataFrame:
    """Pieces that fit the budget by score, in page order, with ``gap`` where something was left out before them."""
    p = pieces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(place).alias("p"), F.col(size).alias("n")))).alias("_p"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<long>").alias("taken"))
    fold = F.aggregate("_p", start, lambda s, x: F.struct(
        F.when(x["n"] <= s["left"], s["left"] - x["n"]).otherwise(s["left"]).alias("left"),
        F.when(x["n"] <= s["left"], F.concat(s["taken"], F.array(x["p"].cast("long")))).otherwise(s["taken"]).alias("taken"),
    ))
    rows = p.withColumn("_f", fold).select(*by, F.explode(F.array_sort("_f.taken")).alias(place))
    before = F.coalesce(F.lag(place).over(Window.partitionBy(*by).orderBy(place)), F.lit(-1))
    return rows.withColumn("gap", F.col(place) != before + 1)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*href=[\"']([^\"']+)[\"']"), 1)


def broken_links(links: DataFrame, pages: DataFrame, target: str, key: str) -> DataFrame:
    """Links whose target no page has."""
    return links.join(pages.select(F.col(key).alias(target)).distinct(), target, "left_anti")


def recall_sites(topics: DataFrame, memory: DataFrame, topic: str, similarity: Column, least: float, rank: Column, rank_least: float, most: int = 10) -> DataFrame:
    """Remembered sites of alike topics that also pass the second score, best first."""
    hit = topics.alias("t").join(memory.alias("m"), similarity >= least).withColumn("_s", rank).where(F.col("_s") >= rank_least)
    w = Window.partitionBy(F.col(f"t.{topic}")).orderBy(F.col("_s").desc(), F.col("m.url"))
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def link_kind(target: Column) -> Column:
    return F.when(target.rlike("^(https?:)?//|^mailto:"), "external").when(target.startswith("#"), "anchor").otherwise("local")


def query_intent(c: Column) -> tuple[Column, Column]:
    """(package, security): the npm package that a search asks about, null for none, and whether it asks for security."""
    low = F.lower(c)
    scoped = F.regexp_extract(low, "(@[a-z0-9][\\w.-]*/[a-z0-9][\\w.-]*)", 1)
    named = F.regexp_extract(low, "\\bnpm\\s+(?:install\\s+|i\\s+|package\\s+|module\\s+)?([a-z0-9][a-z0-9._-]*)", 1)
    package = F.when(scoped != "", scoped).when(named != "", named)
    return package, low.rlike("\\bcve-[0-9]{4}-[0-9]+|\\b(?:security|vulnerab\\w*|advisor(?:y|ies)|exploit\\w*)\\b")


def crawl(pages: DataFrame, by: list[str], order: str, chars: str, budget: int) -> DataFrame:
    """Pages in order up to ``budget`` characters, with ``taken`` of each: the page that crosses the budget is cut."""
    before = F.coalesce(F.sum(chars).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("taken", F.least(F.col(chars), budget - before)).where(F.col("taken") > 0)
