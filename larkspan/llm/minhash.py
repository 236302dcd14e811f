"""Near-duplicates by circulant MinHash.

A text is the set of its distinct ``WORDS``-word shingles, as 64-bit hashes. Two
permutations of the 64-bit numbers make the whole signature: the first scatters
the shingles, the second, shifted circularly by one place more for each
coordinate, orders them; coordinate k is the least of the second permutation at
(first permutation of the shingle) + k modulo 2**64. ``ROWS`` coordinates are a
band; sets that share a band are candidates (``linking.py``), and every link is
verified on the whole sets.

Two sets of similarity s share none of the bands with probability
(1 - s**ROWS)**BANDS: below 1e-9 at 0.8, and below 1e-12 from 0.85 on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import kernel, linking, rows as keyed
from larkspan.session import materialize, ship

WORDS = 4
BANDS, ROWS = 40, 4
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def scatter(h: np.ndarray) -> np.ndarray:
    """The first permutation."""
    return kernel.mix(h ^ np.uint64(0x2545F4914F6CDD1D))


def order(y: np.ndarray) -> np.ndarray:
    """The second permutation."""
    t = y * _A
    return (t ^ (t >> np.uint64(32))) * _B


def signatures(hashes: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinates, sets): the circulant MinHash of every set that has shingles; zeros of an empty one."""
    out = np.zeros((coordinates, len(at) - 1), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    # the shift by k enters the first product of the second permutation as k times its multiplier
    t, first = scatter(hashes) * _A, at[:-1][some]
    place, high = np.empty_like(t), np.empty_like(t)
    for k in range(coordinates):
        np.add(t, np.uint64(k * int(_A) & 0xFFFFFFFFFFFFFFFF), out=place)
        np.right_shift(place, np.uint64(32), out=high)
        np.bitwise_xor(place, high, out=place)
        np.multiply(place, _B, out=place)
        out[k, some] = np.minimum.reduceat(place, first)
    return out


def bands(hashes: np.ndarray, at: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, n): a hash of each band of each set, in which the band's number counts."""
    sig = signatures(hashes, at, n * rows).reshape(n, rows, -1)
    h = kernel.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))[:, None] ^ np.zeros(sig.shape[2], np.uint64)
    for r in range(rows):
        h = kernel.mix(h * np.uint64(0xD1B54A32D192ED03) + sig[:, r])
    return np.ascontiguousarray(h.T)


def points(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(_id, r1, r2, k1, k2, size, p, post) of every row: id, key of id and text, key and size of its set, parities, bands."""
    def run(batches):
        for b in batches:
            for i, j, texts in kernel.chunks(b.column(3)):
                h, at = linking.shingle_sets(texts, words)
                k1, k2 = linking.keys(h, at)
                post = bands(h, at)
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(i, j - i) for c in b.columns[:3]), pa.array(k1), pa.array(k2), pa.array(np.diff(at).astype(np.int32)),
                    linking.lists(*linking.parities(h, at)), linking.lists(post.reshape(-1), np.arange(len(post) + 1) * post.shape[1]),
                ], names=["_id", "r1", "r2", "k1", "k2", "size", "p", "post"])

    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_id"), *keyed.key(id_col, text_col), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"_id {id_type}, r1 long, r2 long, k1 long, k2 long, size int, p array<long>, post array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over pairs of a Jaccard
    similarity of at least 0.8 over ``words``-word shingles, ASCII letters in
    lower case; ``kept`` says whether it is the row's own. A text of fewer words
    is one shingle; texts that are null or without words are empty sets and
    linked with nothing. Null ids are carried through and are the component
    only where no other is. Rows that repeat, and different texts of equal sets,
    are one set; very long texts are whole sets. Empty tables give empty results;
    other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    rows = materialize(points(docs, id_col, text_col, words), "points")
    nodes = linking.nodes_of(rows)
    posts = materialize(nodes.select("node", F.explode("post").alias("s")), "bands")
    found = linking.components(nodes, posts, lambda some: linking.wanted_sets(docs, rows, some, id_col, text_col, words))
    grouped = linking.row_groups(rows.select("_id", "size", "k1", "k2"), nodes, found)
    least = materialize(grouped.groupBy("group").agg(F.min("_id").alias("component_id")), "least")
    linked = grouped.join(least, "group").select("_id", "size", "component_id")
    alone = rows.where("size = 0").select("_id", "size", F.col("_id").alias("component_id"))
    return linked.union(alone).select(
        F.col("_id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: near-duplicates among all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
