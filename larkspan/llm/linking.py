"""Components of sets that are similar, from postings of what similar sets share.

Rows that hold the same set are one node, known by 128 bits of the set and then
by a number. Nodes that hold one posting key may be similar. The pairs of a
family are not listed: each node is first compared with one hub, the holder of
a list that shares most with all others, then with the hubs of its other lists
(with all of them at once where there are pairs to begin with), and
only lists that still hold several components are joined with themselves,
across components. Pairs whose parities differ in more bits than similar sets
have different shingles are dropped; every link is verified on whole sets of
64-bit shingle hashes.

Keys that many rows share are counted by partial aggregates, and the counts are
written before they are joined back: both sides of such a join are then plain
exchanges, so that Spark can split a hot key (adaptive skew join). Whole sets
are computed where the texts are read, for the rows that a bit map of a fixed
size lets pass, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larkspan.llm import graphs, kernel, rows as keyed
from larkspan.session import materialize

#: Least 64-bit words of a set's parities: of each class of hashes, whether it holds an odd number.
PARITIES = 8
#: Bits of the map that names the rows whose sets are asked for.
MAP_BITS = 1 << 26


def shingle_sets(texts: kernel.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted by text and hash, and where each text's begin.

    A text of fewer words is one shingle; one without words has none.
    """
    low = kernel.Texts(kernel.LOWER[texts.buf], texts.at)
    start, end, first = low.words()
    h = low.span_hash(start, end)
    n = np.diff(first)
    doc = kernel.owner(first)
    at = np.arange(len(h))
    fits = at + words <= first[1:][doc]
    hashes, docs = kernel.windows(h, words)[at[fits]] if fits.any() else h[:0], doc[fits]
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        # words of a short text are chained one by one, from their number
        one = n[few].astype(np.uint64)
        for k in range(words - 1):
            more = n[few] > k
            one[more] = kernel.mix(one[more] * np.uint64(0xD1B54A32D192ED03) + h[first[:-1][few[more]] + k])
        hashes, docs = np.concatenate([hashes, one]), np.concatenate([docs, few])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(n) + 1))


def keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two numbers; zeros of an empty one."""
    size = np.diff(at)
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(hashes ^ np.uint64(seed)))])
        out.append(np.where(size > 0, kernel.mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def parities(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the parities of all sets, and where each set's begin.

    A set of up to 512 shingles has 512 parities, a larger one the next power of two.
    """
    size = np.diff(at)
    words = np.maximum(PARITIES, 1 << np.ceil(np.log2(np.maximum(size, 1) / 64)).clip(0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(size)), size)
    bit = (hashes & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64) + 64 * first[owner]
    odd = (np.bincount(bit, minlength=64 * first[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), first


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def parities_fit(x: str, y: str) -> Column:
    """Whether the sets of rows ``x`` and ``y`` (size, p) may be similar: they differ in at least as many shingles as parities.

    Parities of two sets of different sizes are folded to the shorter length.
    """
    p, q, a, b = F.col(f"{x}.p"), F.col(f"{y}.p"), F.col(f"{x}.size"), F.col(f"{y}.size")
    n = F.least(F.size(p), F.size(q))  # similar sets have as many, or one of them twice as many

    def folded(words, i):
        return F.when(F.size(words) == n, F.get(words, i)).otherwise(F.get(words, i).bitwiseXOR(F.get(words, i + n)))

    add = lambda total, i: total + F.bit_count(folded(p, i).bitwiseXOR(folded(q, i)))
    differ = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * differ <= a + b)


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, k1, k2, size, p, post) of the distinct sets of ``rows`` (k1, k2, size, p, post), with ``fp`` where rows have it; empty sets have none.

    Numbers are dealt while the table is written, so whatever reads it sees the same ones.
    """
    firsts = [F.first(c).alias(c) for c in ("size", "p", "post", "fp") if c in rows.columns]
    return materialize(rows.where("size > 0").groupBy("k1", "k2").agg(*firsts).withColumn("node", F.monotonically_increasing_id()), "nodes")


def bit_map(rows: DataFrame) -> np.ndarray:
    """A map of ``MAP_BITS`` bits in which the two bits of each row's key r1 are set, as bytes."""
    bit = F.explode(F.array(F.col("r1"), F.shiftrightunsigned("r1", 32))).alias("b")
    at = rows.select(bit).select(F.col("b").bitwiseAND(F.lit(MAP_BITS - 1)).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.uint64)
    for b in words.toArrow().to_batches():  # at most MAP_BITS / 64 rows
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    return out.view(np.uint8)


def in_map(r1: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(r1), bool)
    for h in (r1, r1 >> np.uint64(32)):
        at = h & np.uint64(MAP_BITS - 1)
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def wanted_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, s): the whole set of each of ``nodes`` (node, k1, k2), from the text of a row (k1, k2, r1, r2, size) of ``docs`` that holds it.

    The map may let other rows pass, more of them the more rows are asked for; a join on the rows' keys drops them.
    """
    some = rows.where("size > 0").groupBy("k1", "k2").agg(F.min("r1").alias("r1"), F.min_by("r2", "r1").alias("r2"))
    chosen = materialize(nodes.select("k1", "k2", "node").join(some, ["k1", "k2"]).select("r1", "r2", "node"), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(chosen))  # MAP_BITS bits

    def run(batches):
        bits = shared.value
        for b in batches:
            b = b.filter(pa.array(in_map(b.column(0).to_numpy().view(np.uint64), bits)))
            for i, j, texts in kernel.chunks(b.column(2)):
                h, at = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists(h, at)], names=["r1", "r2", "s"])

    text = docs.select(*keyed.key(id_col, text_col), F.col(text_col).alias("text"))
    found = text.mapInArrow(run, "r1 long, r2 long, s array<long>").join(chosen, ["r1", "r2"])
    # rows that repeat give a set once
    return found.groupBy("node").agg(F.first("s").alias("s"))


def components(
    nodes: DataFrame, posts: DataFrame, sets: Callable[[DataFrame], DataFrame], fit: Callable[[Column, Column, Column, Column], Column] | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """(node, component) of the ``nodes`` that are not the least of their component.

    ``posts`` has (s, node) and is written; with ``fit(size, size, pos, pos)``,
    which says whether two holders of one key may be similar, also size and
    pos. ``sets(nodes)`` gives the whole sets (node, s) of some nodes. Pairs
    ``near`` (u, v) are verified with those of the hubs, in one round: a round is
    dozens of jobs, which the driver keeps track of however few pairs there are.
    """
    more = [] if fit is None else ["size", "pos"]
    counts = materialize(posts.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    held = materialize(posts.join(counts, "s"), "held")
    # the set that most of a family was made from shares most with the others: as a hub it links them all
    weight = materialize(held.groupBy("node").agg(F.sum("n").alias("w")), "weights")
    known = materialize(nodes.join(weight, "node").select("node", "k1", "k2", "size", "p"), "known")
    first = F.max(F.struct("w", (-F.col("node")).alias("node"), *more)).alias("hub")
    hubs = materialize(held.join(weight, "node").groupBy("s").agg(first).select("s", (-F.col("hub.node")).alias("u"), *[F.col(f"hub.{c}").alias(f"u_{c}") for c in more]), "hubs")
    met = held.join(hubs, "s").where(F.col("node") != F.col("u"))
    if fit is not None:
        met = met.where(fit(F.col("u_size"), F.col("size"), F.col("u_pos"), F.col("pos")))
    star = materialize(met.groupBy("u", F.col("node").alias("v")).agg(F.count("*").alias("n")), "star")

    def alike(pairs: DataFrame) -> DataFrame:
        some = known.select("node", "size", "p")
        both = pairs.join(some.alias("y"), F.col("v") == F.col("y.node")).join(some.alias("x"), F.col("u") == F.col("x.node"))
        return both.where(parities_fit("x", "y")).select("u", "v")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "candidates")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        whole = materialize(sets(known.join(wanted, "node", "left_semi")), "sets")
        both = pairs.join(whole.select(F.col("node").alias("v"), F.col("s").alias("y")), "v").join(whole.select(F.col("node").alias("u"), F.col("s").alias("x")), "u")
        shared = F.size(F.array_intersect("x", "y"))
        return materialize(both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("u", "v"), "links")

    def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        of = found.select("node", "component")
        ends = pairs.join(of.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        ends = ends.join(of.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        return ends.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return found
        return graphs.components(found.select(F.col("component").alias("u"), F.col("node").alias("v")).union(links))

    if near is None:
        nearest = star.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).select("u", "v")
        found = graphs.components(verified(alike(nearest)))
        found = joined(found, verified(alike(across(star.select("u", "v"), found))))
    else:
        both = star.select("u", "v").union(near.select("u", "v"))
        found = graphs.components(verified(alike(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())))
    labelled = held.drop("n").join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("s")
    apart = labelled.drop("size").join(materialize(mixed, "mixed"), "s").join(known.select("node", "size", "p"), "node")
    apart = materialize(apart, "apart")
    meet = (F.col("x.s") == F.col("y.s")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
    if fit is not None:
        meet = meet & fit(F.col("x.size"), F.col("y.size"), F.col("x.pos"), F.col("y.pos"))
    # the bound is part of the join, so pairs that cannot be similar never leave it
    rest = apart.alias("x").join(apart.alias("y"), meet & parities_fit("x", "y")).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    # pairs that were compared at a hub are not compared again
    hubbed = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return joined(found, verified(rest.join(hubbed, ["u", "v"], "left_anti")))


def row_groups(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The ``rows`` (k1, k2, ...) of sets with words, with ``group``, the component of their set; written."""
    of = nodes.select("k1", "k2", "node").join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("group"))
    return materialize(rows.where("size > 0").join(materialize(of, "classes"), ["k1", "k2"]), "grouped")
