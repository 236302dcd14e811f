"""Near-duplicates by the Jaccard similarity of word shingles, exactly.

A text is the set of its distinct ``WORDS``-word shingles, as 64-bit hashes.
The sets whose SimHashes meet in op2's grids (``simhash.py``) are verified
and linked. SimHash misses pairs of this similarity, so sets are also compared by
what they share: with the hubs in the same round, then across components. Under one total order of shingles, two sets of similarity 0.8 or more share one
of the first ``size - ceil(0.8 size) + 1`` of either (prefix filter), so nothing
is missed. Shingles that are frequent in a sample come last in the order; the
sample changes the cost, never the result. What shares a shingle of its prefix
is linked and verified by ``linking.py``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import kernel, linking, rows as keyed, simhash
from larkspan.session import materialize, ship

WORDS = 5
#: Documents in the sample that orders the shingles, holders from which one is frequent, and how many are told apart.
SAMPLE, FREQUENT, TOLD = 8192, 4, 1 << 16


def _frequent(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """(2, n): the sample's frequent shingles in ascending order and their holders."""
    nth = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(nth)) == 0).select(text_col)

    def run(batches):
        for b in batches:
            for _, _, texts in kernel.chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(linking.shingle_sets(texts, words)[0].view(np.int64))], names=["s"])

    n = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = sorted(tuple(r) for r in n.orderBy(F.col("n").desc(), "s").limit(TOLD).collect())
    return np.array(top, np.int64).reshape(-1, 2).T


def points(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(_id, r1, r2, k1, k2, size, p, post, fp) of every row: id, key of id and text, key and size of its set, parities, the shingles that may meet a similar set, SimHash."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, id_col, text_col, words))  # at most TOLD shingles

    def run(batches):
        told, holders = frequent.value
        for b in batches:
            for i, j, texts in kernel.chunks(b.column(3)):
                h, at = linking.shingle_sets(texts, words)
                size = np.diff(at)
                rank = np.zeros(len(h), np.int64)
                if len(told):
                    k = np.minimum(np.searchsorted(told, h.view(np.int64)), len(told) - 1)
                    rank = np.where(told[k] == h.view(np.int64), holders[k], 0)
                doc = np.repeat(np.arange(j - i), size)
                order = np.lexsort((h, rank, doc))
                most = np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)
                kept = order[np.arange(len(h)) - at[:-1][doc] < most[doc]]
                k1, k2 = linking.keys(h, at)
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(i, j - i) for c in b.columns[:3]), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32)),
                    linking.lists(*linking.parities(h, at)), linking.lists(h[kept], np.concatenate([[0], np.cumsum(most)])),
                    pa.array(simhash.of_sets(h, at).view(np.int64)),
                ], names=["_id", "r1", "r2", "k1", "k2", "size", "p", "post", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_id"), *keyed.key(id_col, text_col), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"_id {id_type}, r1 long, r2 long, k1 long, k2 long, size int, p array<long>, post array<long>, fp long")


def _near(nodes: DataFrame) -> DataFrame:
    """(u, v) of ``nodes`` (node, fp) whose SimHashes are equal or meet in op2's grids."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    same = nodes.select("node", "fp").join(first, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    met = simhash.pairs(first.select("fp")).select(F.col("u").alias("fp"), F.col("v").alias("other"))
    met = met.join(first, "fp").select(F.col("other").alias("fp"), F.col("first").alias("u")).join(first, "fp")
    return same.union(met.select("u", F.col("first").alias("v")))


def _sizes_fit(a, b, i, j):
    """Whether sets of ``a`` and ``b`` shingles that first meet at their ``i``-th and ``j``-th may be similar."""
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * F.least(a - i, b - j) >= 4 * (a + b))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, r1, r2, group) of every row: rows of one ``group`` are joined by pairs of a Jaccard similarity of at least 0.8.

    A text of fewer words is one shingle; null and empty texts and those
    without words are one group; very long texts are whole sets. Rows that
    repeat, and different texts of equal sets, share a group; null ids are
    carried through; an empty table gives an empty result; columns that are
    not named are not read, whatever their names.
    """
    ship(docs.sparkSession)
    rows = materialize(points(docs, id_col, text_col, words), "points")
    nodes = linking.nodes_of(rows)
    posts = materialize(nodes.select("node", "size", F.posexplode("post").alias("pos", "s")), "postings")
    found = linking.components(nodes, posts, lambda some: linking.wanted_sets(docs, rows, some, id_col, text_col, words), _sizes_fit, _near(nodes))
    some = linking.row_groups(rows.select("_id", "r1", "r2", "size", "k1", "k2"), nodes, found)
    return some.select("_id", "r1", "r2", "group").union(rows.where("size = 0").select("_id", "r1", "r2", F.lit(-1).cast("long")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over pairs of a Jaccard
    similarity of at least 0.8 over ``words``-word shingles, ASCII letters in
    lower case; null ids are carried through. A text of fewer words is one
    shingle; texts without words are alike; null counts as one; very long texts
    are whole sets. Empty tables give empty results, repeated rows are kept,
    other columns are not read, whatever their names.
    """
    rows = materialize(grouped(docs, id_col, text_col, words), "grouped")
    least = materialize(rows.groupBy("group").agg(F.min("_id").alias("component_id")), "least")
    return rows.join(least, "group").select(F.col("_id").alias(id_col), "component_id")
