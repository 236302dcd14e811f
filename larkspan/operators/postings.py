"""A stored lexical index: postings in blocks, changed file by file, searched with block maxima.

Tables of the store (``store.py``), each in generations:

* ``postings``: blocks of up to ``BLOCK`` postings of one term in one shard of documents, in the order of the documents:
  their ids, weighted frequencies, lengths and the positions of the term; and for the block its first and last document,
  the highest frequency, the least length and its best posting. Folders by bucket of the term's hash.
* ``documents``: length, tokens and kept columns of each document.
* ``terms``: by how many documents a generation changes a term's document frequency; sums are those of the live documents.
* ``dead``: documents that a generation replaces or removes, and the generation that has them.

A change therefore writes the postings of the changed documents and nothing
else. A search reads the postings of the terms asked for. It first looks at the
blocks' maxima alone: the best postings of a term's blocks are a lower bound of
what the k-th document scores, terms that together cannot reach it need no
reading where no other term of the query has a block, and what is left is
scored shard by shard, where terms that cannot lift a new document into the
first k only add to those that are there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.functions import text as tx
from larkspan.operators.store import Store
from larkspan.session import ship, spread

K1, B = 1.2, 0.75
BLOCK = 128
#: Documents of a shard, about; buckets of terms.
SHARD_DOCS, BUCKETS = 4096, 64
#: Positions of a field; fields follow each other at multiples of it.
FIELD = 1 << 26
#: Terms of the queries that are searched at once; more are searched in slices.
SENT_TERMS = 100_000
TABLES = ("postings", "documents", "terms", "dead")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _shards(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _frequency(at: Column, weights: list[float]) -> Column:
    """The weighted number of positions."""
    weight = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(at, F.lit(0.0), lambda s, a: s + F.get(weight, F.shiftright(a, 26)))


def shard_blocks(table: pa.Table, weights: list[float]) -> pa.Table:
    """The blocks (shard, term, block, ...) of the documents (doc, dl, shard, toks: an array of tokens for each field) of one shard."""
    toks, docs, length = table.column("toks").combine_chunks(), table.column("doc").combine_chunks(), table.column("dl").to_numpy()
    by_id = pc.sort_indices(docs)
    rank = np.empty(len(docs), np.int64)
    rank[by_id.to_numpy()] = np.arange(len(docs))
    fields, tokens = toks.flatten(), toks.flatten().flatten()
    size = pc.list_value_length(fields).to_numpy()
    doc = np.repeat(np.repeat(rank, pc.list_value_length(toks).to_numpy()), size)
    field = np.repeat(np.tile(np.arange(len(weights)), len(docs)), size)
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size) + field * FIELD
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((at, doc, code))
    code, doc, at, field = code[order], doc[order], at[order], field[order]
    # occurrences are runs of a posting, postings runs of a term, and blocks pieces of those runs
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
    f = np.add.reduceat(np.array(weights)[field], starts) if len(starts) else np.zeros(0)
    dl, term, doc = length[by_id.to_numpy()][doc[starts]], code[starts], doc[starts]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    nth = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
    cut = np.flatnonzero(nth % BLOCK == 0)
    ends = np.append(cut, len(term))
    reached = f / (f + K1 * (1 - B + B * dl / 200.0))  # by any one length; whichever posting it is, its document scores that much
    top = np.maximum.reduceat(reached, cut) if len(cut) else reached
    best = np.flatnonzero(reached == np.repeat(top, np.diff(ends)))
    best = best[np.searchsorted(best, cut)]
    listed = lambda values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    ids, places = docs.take(by_id).take(pa.array(doc)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
    least = np.minimum.reduceat(dl, cut) if len(cut) else dl
    most = np.maximum.reduceat(f, cut) if len(cut) else f
    return pa.table({
        "shard": pa.array(np.full(len(cut), table.column("shard")[0].as_py(), np.int32)), "term": coded.dictionary.take(pa.array(term[cut])),
        "block": pa.array((nth[cut] // BLOCK).astype(np.int32)), "n": pa.array(np.diff(ends).astype(np.int32)), "first": ids.take(pa.array(cut)),
        "last": ids.take(pa.array(ends[1:] - 1)), "max_f": pa.array(most), "min_dl": pa.array(least.astype(np.int32)), "best_f": pa.array(f[best]),
        "best_dl": pa.array(dl[best].astype(np.int32)), "docs": listed(ids), "fs": listed(pa.array(f)), "dls": listed(pa.array(dl.astype(np.int32))), "ats": listed(places),
    })


def _blocks(docs: DataFrame, weights: list[float], shards: int, buckets: int) -> DataFrame:
    """The blocks of documents (doc, dl, toks); tokens are shuffled once, a shard at a time is cut into blocks."""
    ship(docs.sparkSession)
    kind = docs.schema["doc"].dataType.simpleString()
    schema = (
        f"shard int, term string, block int, n int, first {kind}, last {kind}, max_f double, min_dl int, best_f double, best_dl int, "
        f"docs array<{kind}>, fs array<double>, dls array<int>, ats array<array<int>>"
    )
    rows = docs.where("dl > 0").select("doc", "dl", "toks", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard"))
    out = rows.groupBy("shard").applyInArrow(lambda table: shard_blocks(table, weights), schema)
    return out.withColumn("bucket", _bucket(F.col("term"), buckets)).sortWithinPartitions("bucket", "shard", "term", "block")


def update(
    store: Store, docs: DataFrame, fields: dict[str, float], doc_id: str = "doc_id", keep: tuple[str, ...] = (), removed: DataFrame | None = None,
    batch: tuple[str, int] | None = None, shard_docs: int = SHARD_DOCS, buckets: int = BUCKETS, extra: dict[str, str] | None = None, base: dict | None = None,
) -> dict:
    """Index ``docs``, in place of what the store has under their ids, and take out ``removed`` (doc_id); returns the new commit.

    ``fields`` gives the weight of each text column, ``keep`` names columns by
    which searches may filter or group; both must stay the same for one store.
    ``extra`` names generations of other tables that become visible with the
    same commit. Documents without tokens count; a null text is empty; ids must
    be unique and not null.
    """
    state = base or store.current()
    buckets = state["facts"].get("buckets", buckets)
    gen = store.generation()
    weights = list(fields.values())
    toks = F.array(*[tx.tokens(F.col(f)) for f in fields])
    src = spread(docs).select(F.col(doc_id).alias("doc"), *keep, toks.alias("toks"))
    dl = F.aggregate("toks", F.lit(0), lambda n, t: n + F.size(t))
    # tokens are taken from the texts once: lengths, terms and blocks are read from there
    new = store.write("documents", gen, src.select("doc", dl.alias("dl"), "toks", *keep))
    total = new.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    shards = _shards(total[0], shard_docs)
    blocks = store.write("postings", gen, _blocks(new, weights, shards, buckets), ("bucket",))
    delta = blocks.groupBy("term").agg(F.sum("n").alias("n"))
    n_docs, length = state["facts"].get("n_docs", 0) + total[0], state["facts"].get("length", 0) + total[1]
    add = {"postings": gen, "documents": gen, "terms": gen, **(extra or {})}
    old = live_documents(store, state)
    if old is not None:
        changed = new.select("doc") if removed is None else new.select("doc").union(removed.select(F.col(doc_id).alias("doc")))
        gone = old.join(changed.distinct(), "doc", "left_semi")
        gone = store.write("dead", gen, gone.select("doc", "dl", F.col("gen").alias("of"), F.array_distinct(F.flatten("toks")).alias("terms")))
        add["dead"] = gen
        left = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n_docs, length = n_docs - left[0], length - left[1]
        delta = delta.union(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("n"))
    store.write("terms", gen, _by_term(delta, buckets))
    facts = {"n_docs": n_docs, "length": length, "buckets": buckets, "weights": weights, "shards": state["facts"].get("shards", {}) | {gen: shards}}
    return store.commit(state, add, facts=facts, batch=batch)


def live_documents(store: Store, state: dict | None = None) -> DataFrame | None:
    """(doc, dl, toks, kept columns, gen) of the documents that no later generation replaced or removed."""
    state = state or store.current()
    docs, dead = store.read("documents", state), store.read("dead", state)
    if docs is None or dead is None:
        return docs
    return docs.join(dead.select("doc", F.col("of").alias("gen")), ["doc", "gen"], "left_anti")


def compact(store: Store, shard_docs: int = SHARD_DOCS) -> dict:
    """Rewrite all generations as one, without what is dead, from the tokens of the live documents; the scores stay."""
    state = store.current()
    docs = live_documents(store, state)
    if docs is None:
        return state
    gen, facts = store.generation(), state["facts"]
    shards = _shards(facts["n_docs"], shard_docs)
    new = store.write("documents", gen, docs.drop("gen"))
    blocks = store.write("postings", gen, _blocks(new, facts["weights"], shards, facts["buckets"]), ("bucket",))
    store.write("terms", gen, _by_term(blocks.groupBy("term").agg(F.sum("n").alias("n")), facts["buckets"]))
    state["tables"].pop("dead", None)
    return store.commit(state, {}, {"postings": gen, "documents": gen, "terms": gen}, facts={"shards": {gen: shards}})


def _by_term(counts: DataFrame, buckets: int) -> DataFrame:
    return counts.where("n <> 0").withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("term")


class Plan:
    """What every shard needs to know: the queries' phrases by number, the phrases' weights, the average length, and k."""

    def __init__(self, queries: list[list[int]], idf: np.ndarray, avgdl: float, k: int) -> None:
        self.queries, self.idf, self.avgdl, self.k = queries, idf, avgdl, k


def gain(f, dl, avgdl):
    """What a posting adds to a score, before its term's weight; of numbers, arrays and columns."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _first_k(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score to six digits, ties by place, among those above 0."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        least = np.partition(score[some], len(some) - k)[len(some) - k] - 1e-6
        some = some[score[some] >= least]
    return some[np.lexsort((some, -np.round(score[some], 6)))[:k]]


def score_shard(plan: Plan, phrase: np.ndarray, at: list[np.ndarray], gains: list[np.ndarray], groups: np.ndarray, n: int) -> tuple[list, int]:
    """[(query, place, score)] of the first k documents of one shard for every query and group, and how many postings were added up.

    Block i belongs to ``phrase[i]`` and holds the documents at the places ``at[i]``, of ``n``; ``groups`` numbers the groups
    of places, -1 for documents that are not to be given. Terms are taken by their highest contribution. Once those left cannot
    reach the k-th score of the moment together, they only add to documents that can still be among the first k, and
    blocks without any are skipped.
    """
    of: dict[int, list[int]] = {}
    for i, p in enumerate(phrase.tolist()):
        of.setdefault(p, []).append(i)
    most = {p: max(float(gains[i].max()) for i in blocks) * plan.idf[p] for p, blocks in of.items()}
    each = [np.flatnonzero(groups == g) for g in range(groups.max(initial=-1) + 1)]
    out, added = [], 0
    for q, phrases in enumerate(plan.queries):
        mine = sorted((p for p in phrases if p in of), key=lambda p: (-most[p], p))
        if not mine:
            continue
        score, left, bar = np.zeros(n), sum(most[p] for p in mine), 0.0
        for p in mine:
            closed = left < bar  # no document that is not there yet can get in
            hopeful = (score > 0) & (score + left >= bar) if closed else None
            for i in of[p]:
                live = hopeful[at[i]] if closed else slice(None)
                if closed and not live.any():
                    continue
                where = at[i][live]
                score[where] += gains[i][live] * plan.idf[p]
                added += len(where)
            left -= most[p]
            # the bar is that of the weakest group
            bar = min((float(np.partition(score[g], len(g) - plan.k)[len(g) - plan.k]) if len(g) > plan.k else 0.0 for g in each), default=0.0) - 1e-6
        for g in each:
            for place in _first_k(score[g], plan.k):
                out.append((q, int(g[place]), float(score[g[place]])))
    return out, added


def _asked(queries: DataFrame, query_id: str, terms: str) -> DataFrame:
    """(query, phrase, parts): the distinct terms of every query, a term with an underscore as the phrase of its parts."""
    rows = queries.select(F.col(query_id).alias("query"), F.explode(terms).alias("term")).distinct().withColumn("parts", tx.tokens(F.col("term")))
    return rows.where(F.size("parts") > 0).select("query", "term", F.array_join("parts", " ").alias("phrase"), "parts")


def _some(df: DataFrame, words: list[str], buckets: int) -> DataFrame:
    """Rows of a table with the columns bucket and term whose term is one of ``words``."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(w,) for w in words], "term string")
    folders = [r[0] for r in wanted.select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect()]
    if len(words) <= 1000:  # as literals they reach the scan
        return df.where(F.col("bucket").isin(folders) & F.col("term").isin(words))
    return df.where(F.col("bucket").isin(folders)).join(F.broadcast(wanted), "term", "left_semi")  # at most SENT_TERMS


def needed_blocks(heads: DataFrame, plan: Plan, words: list[str]) -> DataFrame | None:
    """(gen, shard, term, block) of the blocks that some query has to read, or None where that is all.

    ``heads`` has the blocks' first and last document and bounds. The k-th best of the best postings of one term's blocks is
    a score that k documents reach. Terms of a query that together stay below cannot bring a document among the first k
    by themselves: their blocks are read only where another term of the query has a block that overlaps.
    """
    spark = heads.sparkSession
    weights = F.broadcast(spark.createDataFrame([(w, float(plan.idf[i])) for i, w in enumerate(words)], "term string, idf double"))
    bound = lambda f, dl: F.col("idf") * gain(F.col(f), F.col(dl), plan.avgdl)
    heads = heads.join(weights, "term").select("gen", "shard", "term", "block", "first", "last", bound("max_f", "min_dl").alias("high"), bound("best_f", "best_dl").alias("low"))
    nth = heads.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.col("low").desc())))
    stats = nth.where(F.col("r") <= plan.k).groupBy("term").agg(F.min("low").alias("low"), F.max("r").alias("r"))
    high = {r["term"]: r["high"] for r in heads.groupBy("term").agg(F.max("high").alias("high")).collect()}
    reached = {r["term"]: r["low"] if r["r"] == plan.k else 0.0 for r in stats.collect()}
    strong, weak = [], []
    for q, phrases in enumerate(plan.queries):
        if any(p >= len(words) for p in phrases):
            strong += [(words[p], q) for p in phrases if p < len(words)]  # has a phrase of several words
            continue
        mine = sorted((words[p] for p in phrases if words[p] in high), key=lambda w: high[w])
        bar, total = max((reached[w] for w in mine), default=0.0) - 1e-6, 0.0
        for w in mine:
            total += high[w]
            (weak if total < bar else strong).append((w, q))
    always = {w for w, _ in strong}
    weak = [(w, q) for w, q in weak if w not in always]
    if not weak:
        return None
    pairs = lambda rows: F.broadcast(spark.createDataFrame(rows, "term string, q int"))
    ranges = heads.join(pairs(strong), "term").groupBy("gen", "shard", "q").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    near = heads.join(pairs(weak), "term").join(ranges, ["gen", "shard", "q"]).where((F.col("first") <= F.col("hi")) & (F.col("last") >= F.col("lo")))
    keys = ["gen", "shard", "term", "block"]
    sure = heads.join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(always)], "term string")), "term", "left_semi").select(keys)
    return sure.union(near.select(keys)).distinct()


def search(
    store: Store, queries: DataFrame, k: int, query_id: str = "query_id", terms: str = "terms", doc_id: str = "doc_id",
    accept: Column | None = None, group: str | None = None, state: dict | None = None,
) -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``k`` documents by BM25 of every query, of each ``group`` where one is named.

    ``terms`` is an array; a term with an underscore is a phrase of its parts.
    ``accept``, over the kept columns, filters documents; statistics are those
    of all. Order: score to six digits, descending, then the id. Queries
    without a match have no row.
    """
    spark = store.spark
    state = state or store.current()
    asked = _asked(queries, query_id, terms)
    ship(spark)
    slices = max(1, -(-asked.count() // SENT_TERMS))
    nth = F.pmod(F.xxhash64("query"), F.lit(slices))
    parts = [_search(store, state, asked.where(nth == i), k, accept, group) for i in range(slices)]
    out = reduce(DataFrame.union, parts)
    return out.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", "rank", *([F.col("_group").alias(group)] if group else []))


def _search(store: Store, state: dict, asked: DataFrame, k: int, accept: Column | None, group: str | None) -> DataFrame:
    """(query, doc, score, rank, _group) of the queries of one slice (query, phrase, parts)."""
    spark = store.spark
    query_type = asked.schema["query"].dataType.simpleString()
    all_ = store.read("postings", state)
    if all_ is None:
        raise ValueError(f"{store.where} has no index")
    doc_type = all_.schema["docs"].dataType.elementType.simpleString()
    facts = state["facts"]
    avgdl, buckets = facts["length"] / max(1, facts["n_docs"]), facts["buckets"]
    rows = asked.collect()
    words = sorted({r["phrase"] for r in rows if len(r["parts"]) == 1})
    several = sorted({(r["phrase"], tuple(r["parts"])) for r in rows if len(r["parts"]) > 1})
    number = {w: i for i, w in enumerate(words)} | {p: len(words) + i for i, (p, _) in enumerate(several)}
    ids = sorted({r["query"] for r in rows})
    at = {q: i for i, q in enumerate(ids)}
    mine: list[list[int]] = [[] for _ in ids]
    for r in rows:  # different terms may come to one phrase; each counts
        mine[at[r["query"]]].append(number[r["phrase"]])
    keep = [f.name for f in store.read("documents", state).schema if f.name not in ("doc", "dl", "toks", "gen")]
    dead = store.read("dead", state)
    shard_of = F.pmod(F.xxhash64("doc"), F.element_at(F.create_map(*[F.lit(x) for g, n in facts["shards"].items() for x in (g, n)]), F.col("gen")))
    chosen = accept is not None or group is not None
    side = None
    if chosen:
        live = live_documents(store, state).select("gen", "doc", *keep)
        live = live if accept is None else live.where(accept)
        side = live.select("gen", "doc", (F.lit(0) if group is None else F.col(group)).cast("string").alias("g"))
    elif dead is not None:
        side = dead.select(F.col("of").alias("gen"), "doc", F.lit("").alias("g"))
    counts = dict(_some(store.read("terms", state), words, buckets).groupBy("term").agg(F.sum("n")).collect()) if words else {}
    spans = _phrases(_some(all_, sorted({w for _, p in several for w in p}), buckets), several, dead, facts["weights"]) if several else None
    if spans is not None:
        counts |= dict(spans.where("alive").groupBy("term").agg(F.count("*")).collect())
    idf = np.zeros(len(number))
    for w, i in number.items():
        n = counts.get(w, 0)
        idf[i] = max(float(np.log((facts["n_docs"] - n + 0.5) / (n + 0.5))), 0.0) or 1e-6
    plan = Plan(mine, idf, avgdl, k)
    found = _some(all_, words, buckets)
    if words and not chosen and dead is None:
        need = needed_blocks(found.select("gen", "shard", "term", "block", "first", "last", "max_f", "min_dl", "best_f", "best_dl"), plan, words)
        if need is not None:
            found = found.join(need, ["gen", "shard", "term", "block"], "left_semi")
    found = found.select("gen", "shard", "term", "docs", "fs", "dls")
    if spans is not None:
        lists = spans.groupBy("gen", "shard", "term").agg(F.array_sort(F.collect_list(F.struct("doc", "f", "dl"))).alias("p"))
        found = found.union(lists.select("gen", "shard", "term", "p.doc", "p.f", "p.dl"))
    shared = spark.sparkContext.broadcast((plan, number))  # at most SENT_TERMS terms

    def score(blocks: pd.DataFrame, side: pd.DataFrame | None) -> pd.DataFrame:
        plan, number = shared.value
        if not len(blocks):
            return pd.DataFrame({"q": [], "doc": [], "score": []})
        docs, where = np.unique(np.concatenate(blocks["docs"].tolist()), return_inverse=True)
        cut = np.cumsum([len(d) for d in blocks["docs"]])[:-1]
        groups = np.full(len(docs), -1 if chosen else 0)
        if side is not None and len(side):
            at = np.minimum(np.searchsorted(docs, side["doc"].to_numpy(docs.dtype)), len(docs) - 1)
            hit = docs[at] == side["doc"].to_numpy(docs.dtype)
            groups[at[hit]] = side["g"].astype("category").cat.codes.to_numpy()[hit] if chosen else -1
        gains = gain(np.concatenate(blocks["fs"].tolist()), np.concatenate(blocks["dls"].tolist()).astype(float), plan.avgdl)
        out, _ = score_shard(plan, np.array([number[t] for t in blocks["term"]]), np.split(where, cut), np.split(gains, cut), groups, len(docs))
        return pd.DataFrame({"q": [q for q, _, _ in out], "doc": pd.Series([docs[i] for _, i, _ in out], dtype=docs.dtype), "score": [s for _, _, s in out]})

    schema = f"q int, doc {doc_type}, score double"
    by = found.groupBy("gen", "shard")
    if side is None:
        hits = by.applyInPandas(lambda pdf: score(pdf, None), schema)
    else:
        hits = by.cogroup(side.withColumn("shard", shard_of.cast("int")).groupBy("gen", "shard")).applyInPandas(score, schema)
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"q int, query {query_type}"))  # at most SENT_TERMS
    within = ["q"]
    if group is not None:
        hits = hits.join(live_documents(store, state).select("doc", F.col(group).alias("_group")), "doc")
        within.append("_group")
    order = Window.partitionBy(*within).orderBy(F.round("score", 6).desc(), "doc")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(names, "q")
    return ranked.select("query", "doc", "score", "rank", *(["_group"] if group else []))


def _phrases(blocks: DataFrame, several: list[tuple[str, tuple[str, ...]]], dead: DataFrame | None, weights: list[float]) -> DataFrame:
    """(gen, shard, term, doc, f, dl, alive): postings of phrases of several words, from the positions of their words."""
    spark = blocks.sparkSession
    parts = spark.createDataFrame([(p, w, i, len(ws)) for p, ws in several for i, w in enumerate(ws)], "phrase string, term string, i int, size int")
    each = blocks.select("gen", "shard", "term", F.inline(F.arrays_zip("docs", "dls", "ats"))).toDF("gen", "shard", "term", "doc", "dl", "ats")
    at = each.join(F.broadcast(parts), "term").select("gen", "shard", "phrase", "size", "doc", "dl", F.explode(F.transform("ats", lambda a: a - F.col("i"))).alias("at"))
    begun = at.groupBy("gen", "shard", "phrase", "size", "doc", "dl", "at").agg(F.count("*").alias("n")).where("n = size")
    out = begun.groupBy("gen", "shard", F.col("phrase").alias("term"), "doc", "dl").agg(_frequency(F.collect_list("at"), weights).alias("f"))
    if dead is None:
        return out.withColumn("alive", F.lit(True))
    gone = dead.select("doc", F.col("of").alias("gen"), F.lit(True).alias("gone"))
    return out.join(gone, ["doc", "gen"], "left").withColumn("alive", F.col("gone").isNull()).drop("gone")
