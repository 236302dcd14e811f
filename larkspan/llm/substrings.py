"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

The reference is the corpus itself: every block of ``window`` consecutive words
of every distinct text. Its index holds the blocks that start at two places or
more, by a 128-bit cryptographic digest of their words, with the least place. Two steps keep unique blocks out of it:

* Winnowing. Of the ``window - gram + 1`` word n-grams in any ``window`` words,
  the one of the least hash is an anchor. Both places of a repeated block
  choose the same n-gram, so a block whose least n-gram is nowhere else an
  anchor is unique. These hashes only choose candidates: equal hashes of
  different words cost time and change nothing.
* The blocks that are left are entered by their digests and counted.

A document is then factored greedily. From the next position whose block is in
the index the factor copies from that block's place, and goes on for as long
as the next block's place is the next one there; then the next factor begins.
A factor is thus a source, a first word and an end, ``window`` words or more.
The blocks that straddle the boundary of two factors have been looked up like
all others, so a boundary neither hides a repeated block nor covers words of
none, and the words that the factors cover are the duplicates.

Rows are told apart by a 128-bit key of id and text, so nulls and repeated ids
need no care. Equal texts are folded first: a text that occurs again consists
of repeated blocks throughout, and one copy lends its blocks to the index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import kernel
from larkspan.session import ship

WINDOW = 35
WORD = re.compile("[^\x20\x09-\x0d]+")
#: A place is a text's code (the upper bits of its key) and a word's position, in one positive number.
POSITION_BITS = 25


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over every ``n`` consecutive elements; the result is n-1 shorter."""
    width = 1
    while 2 * width <= n:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(grams: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Positions whose n-gram has the least hash among some ``span`` consecutive ones of its document.

    In a run of equal hashes the first, the last and every ``span // 2``-th stand for all.
    """
    n = len(grams)
    if n < span:
        return np.zeros(0, np.int64)
    low = np.where(doc[: n - span + 1] == doc[span - 1 :], _slide(grams, span, np.minimum), np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), span, np.maximum)
    chosen = (high == grams) & (high > 0)
    alike = np.zeros(n, bool)
    alike[1:] = (grams[1:] == grams[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~alike)
    nth = np.arange(n) - first[np.cumsum(~alike) - 1]
    last = np.ones(n, bool)
    last[:-1] = ~alike[1:]
    return np.flatnonzero(chosen & (last | (nth % (span // 2) == 0)))


class _Grams:
    """Hashes of the word n-grams of some texts, and the least of each window of words."""

    def __init__(self, texts: kernel.Texts, window: int) -> None:
        self.start, self.end, self.first = texts.words()
        h = texts.span_hash(self.start, self.end)
        gram = window // 2 + 1
        self.span = window - gram + 1
        self.doc = kernel.owner(self.first)
        none = np.zeros(0, np.uint64)
        self.grams = kernel.windows(h, gram) if len(h) >= window else none
        n = len(self.grams)
        # an n-gram belongs to the document that it lies in; those that straddle two get no owner
        self.owner = np.where(self.doc[:n] == self.doc[gram - 1 :], self.doc[:n], -1 - np.arange(n)) if n else self.doc[:0]
        self.low = _slide(self.grams, self.span, np.minimum) if n else none
        self.whole = self.doc[: len(self.low)] == self.doc[window - 1 :] if n else np.zeros(0, bool)


def _find_anchors(keys: pa.RecordBatch, texts: kernel.Texts, window: int) -> pa.RecordBatch:
    g = _Grams(texts, window)
    at = anchors(g.grams, g.owner, g.span)
    pos = at - g.first[:-1][g.doc[at]]
    of = pa.array(g.doc[at])
    return pa.RecordBatch.from_arrays(
        [keys.column(0).take(of), keys.column(1).take(of), pa.array(pos.astype(np.int32)), pa.array(g.grams[at].view(np.int64))],
        names=["r1", "r2", "pos", "h"],
    )


def block_digests(texts: kernel.Texts, starts: np.ndarray, doc: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """(n, 2): 128-bit digests of the ``window`` words, joined by one space, from each of ``starts`` (sorted) on."""
    begin, end, first = spans
    out, blake = [], hashlib.blake2b
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(starts) else []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        d = doc[i]
        words = memoryview(b" ".join(texts.buf[texts.at[d] : texts.at[d + 1]].tobytes().split()))
        lo, hi = first[d], first[d + 1]
        at = np.concatenate([[0], np.cumsum(end[lo:hi] - begin[lo:hi] + 1)])
        a, b = at[starts[i:j] - lo].tolist(), (at[starts[i:j] - lo + window] - 1).tolist()
        out += [blake(words[x:y], digest_size=16).digest() for x, y in zip(a, b, strict=True)]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _find_blocks(keys: pa.RecordBatch, texts: kernel.Texts, at: pa.Array, window: int) -> pa.RecordBatch:
    g = _Grams(texts, window)
    counts = np.array([len(a) for a in at], np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.concatenate([np.zeros(0, np.int64), *(np.asarray(a, np.int64) for a in at)])
    again = np.unique(g.grams[pos + g.first[:-1][doc]])
    starts = np.flatnonzero(g.whole & np.isin(g.low, again))
    of = g.doc[starts]
    digests = block_digests(texts, starts, of, (g.start, g.end, g.first), window)
    row = pa.array(of)
    return pa.RecordBatch.from_arrays(
        [keys.column(0).take(row), keys.column(1).take(row), pa.array((starts - g.first[:-1][of]).astype(np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1])],
        names=["r1", "r2", "start", "d1", "d2"],
    )


def factors(blocks: list[tuple[int, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """Greedy factors (first word, end, place it copies from) over sorted (start, place) of the blocks found in the index."""
    i, n = 0, len(blocks)
    while i < n:
        first, source = blocks[i]
        i += 1
        while i < n and blocks[i][0] - first == blocks[i][1] - source == blocks[i - 1][0] + 1 - first:
            i += 1
        yield first, blocks[i - 1][0] + window, source


def spans(parsed: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The words that factors cover, as disjoint spans."""
    out: list[tuple[int, int]] = []
    for a, b, _ in parsed:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pack(df: DataFrame, schema: str) -> DataFrame:
    """(r1, r2, _id, text) with the text compressed, for the one shuffle that it goes through."""
    ship(df.sparkSession)

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = [zip_(t.as_py().encode("utf-8")) if t.is_valid else None for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], names=["r1", "r2", "_id", "text"])

    return df.mapInArrow(run, schema)


def _unpacked(column: pa.Array, limit: int = kernel.CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, texts) of pieces of about ``limit`` bytes of a column of compressed texts."""
    unzip = zstandard.ZstdDecompressor().decompress
    start, size, part = 0, 0, []
    for i, z in enumerate(column):
        part.append(unzip(z.as_py()).decode("utf-8") if z.is_valid else None)
        size += len(part[-1] or "")
        if size >= limit:
            yield start, i + 1, pa.array(part, pa.large_string())
            start, size, part = i + 1, 0, []
    if part:
        yield start, len(column), pa.array(part, pa.large_string())


def _map(df: DataFrame, fn, schema: str, which) -> DataFrame:
    """``fn(batch, texts)`` over the rows for which ``which(batch)`` is true."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            b = b.filter(pc.fill_null(which(b), False))
            for i, j, column in _unpacked(b.column(3)):
                for k, n, texts in kernel.chunks(column, 1 << 62):
                    yield fn(b.slice(i + k, n - k), texts)

    return df.mapInArrow(run, schema)


def _again(rows: DataFrame, by: list[str], *more) -> DataFrame:
    """``rows`` whose key ``by`` occurs more than once, with the aggregates ``more`` of the key.

    The join is on the complements of the keys, so that both sides of it are
    exchanges of their own and Spark can split a hot key (adaptive skew join).
    """
    other = [F.bitwise_not(k).alias(f"not_{k}") for k in by]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), *more).where("n > 1").drop("n")
    return rows.select("*", *other).join(counts.select(*other, *[c for c in counts.columns if c not in by]), [f"not_{k}" for k in by])


def repeated_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``base`` (r1, r2, _id, compressed text, copies, lends) and ``found`` (r1, r2, starts, places) of the rows that hold repeated blocks.

    Text is shuffled once, by the row's key (r1, r2); the stages that read it share that exchange.
    """
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).withColumn("key", key)
    src = src.select(F.xxhash64("key", "_id").alias("r1"), F.xxhash64(F.lit(1), "_id", "key").alias("r2"), "_id", "text", "key")
    id_type = src.schema["_id"].dataType.simpleString()
    keyed = src.select("r1", "r2", "key", F.xxhash64("_id").alias("i"))
    classes = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("i").alias("lender"))
    # joined by the reversed digest: both sides are then exchanges of their own, and Spark can split a hot text
    back = F.reverse("key").alias("yek")
    flags = keyed.select("r1", "r2", "i", back).join(classes.select(back, "copies", "lender"), "yek").groupBy("r1", "r2").agg(
        F.max("copies").alias("copies"), F.max(F.col("i") == F.col("lender")).alias("lends"),
    )
    base = _pack(src.drop("key"), f"r1 long, r2 long, _id {id_type}, text binary").join(flags.hint("shuffle_hash"), ["r1", "r2"], "left")

    # Every reader takes all rows and columns of ``base`` and skips inside Python what it has no use for: a filter, an inner
    # join or a shorter row would be pushed below the exchange of the text, which then could not be shared.
    def lent(batch, texts):
        return _find_anchors(batch, texts, window)

    def lookup(batch, texts):
        return _find_blocks(batch, texts, batch.column(6).to_pylist(), window)

    anchor = _map(base, lent, "r1 long, r2 long, pos int, h long", lambda b: b.column(5))
    at = _again(anchor, ["h"]).groupBy("r1", "r2").agg(F.collect_list("pos").alias("at"))
    near = base.join(at.hint("shuffle_hash"), ["r1", "r2"], "left")
    blocks = _map(near, lookup, "r1 long, r2 long, start int, d1 long, d2 long", lambda b: pc.and_(b.column(5), pc.is_valid(b.column(6))))
    last = (1 << POSITION_BITS) - 1
    place = F.shiftleft(F.shiftrightunsigned("r1", POSITION_BITS + 1), POSITION_BITS) + F.least(F.col("start"), F.lit(last))
    found = _again(blocks, ["d1", "d2"], F.min(place).alias("place")).select("r1", "r2", "start", "place")
    # both lists gather the same rows in the same order; a list of structs would be three times as long
    return base, found.groupBy("r1", "r2").agg(F.collect_list("start").alias("starts"), F.collect_list("place").alias("places"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Words of every row of ``docs`` that repeated blocks cover.

    Returns the id, ``n_words``, ``n_removed``, ``kept`` (the other words, joined
    by one space), ``spans``, pairs of first word and end, and ``factors``,
    triples of first word, end and the place copied from: ``place >> 25`` tells
    source texts apart, the rest is the word there; at the least place of all
    that is the place itself, the original of the others; a text that occurs again as
    a whole is one span without factors. A word goes if a block of ``window``
    consecutive words that covers it starts anywhere else too, in the same row
    or another. A null or empty text has no words, a text of fewer than
    ``window`` words keeps them, a very long text is parsed whole in one task.
    An empty table gives an empty result. Repeated rows are copies of each
    other and lose every block; rows of one id with different texts are
    different documents; null ids are ids like any other. Other columns are
    not read, whatever their names.
    """
    base, found = repeated_blocks(docs, id_col, text_col, window)
    joined = base.join(found.hint("shuffle_hash"), ["r1", "r2"], "left")
    id_type = joined.schema["_id"].dataType.simpleString()
    span = [("first", pa.int32()), ("end", pa.int32())]

    def run(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            n_words, n_removed, kept, where, parsed = [], [], [], [], []
            for text, copies, starts, places in zip(b.column(3), b.column(4), b.column(6), b.column(7), strict=True):
                words = WORD.findall(unzip(text.as_py()).decode("utf-8") if text.is_valid else "")
                factor = []
                if (copies.as_py() or 1) > 1 and len(words) >= window:
                    cover = [(0, len(words))]
                else:
                    if starts.is_valid:
                        factor = list(factors(sorted(zip(starts.as_py(), places.as_py(), strict=True)), window))
                    cover = spans(factor)
                left, last = [], 0
                for a, e in cover:
                    left += words[last:a]
                    last = e
                left += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(" ".join(left))
                where.append([{"first": a, "end": e} for a, e in cover])
                parsed.append([{"first": a, "end": e, "place": s} for a, e, s in factor])
            yield pa.RecordBatch.from_arrays([
                b.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                pa.array(where, pa.list_(pa.struct(span))), pa.array(parsed, pa.list_(pa.struct([*span, ("place", pa.int64())]))),
            ], names=["_id", "n_words", "n_removed", "kept", "spans", "factors"])

    ship(docs.sparkSession)
    out = joined.mapInArrow(
        run, f"_id {id_type}, n_words long, n_removed long, kept string, spans array<struct<first:int,end:int>>, "
        "factors array<struct<first:int,end:int,place:bigint>>",
    )
    return out.withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: words removed from all ``documents``."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
b AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)
), again AS (SELECT h FROM b GROUP BY h HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM b JOIN again USING (h)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
m AS (SELECT word.doc_id, word.p, word, cover.p IS NOT NULL AS gone FROM word LEFT JOIN cover ON cover.doc_id = word.doc_id AND cover.p = word.p),
r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""
