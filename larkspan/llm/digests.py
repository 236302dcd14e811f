"""Similarity digests from statistically improbable features.

A feature is any window of ``WINDOW`` bytes of a text. Its byte entropy falls
into a bin; how rare that bin is over the whole corpus ranks the feature. Among
every ``NEIGHBOURS`` consecutive features the rarest gains a point, and features
with ``POINTS`` or more are selected. Selected features set five bits each in a
Bloom filter of 2048 bits; a filter that holds ``CAPACITY`` features is full and
the next in the chain begins.

Two digests are compared by the bits that filters share, beyond the share that
chance would give: every filter of the shorter chain takes its best match in
the other, and the scores are averaged by the number of features.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import kernel
from larkspan.session import ship

WINDOW = 32
NEIGHBOURS = 32
POINTS = 8
CAPACITY = 160
BITS = 2048
PROBES = 5
BINS = 1000
#: Share of the room between chance and full overlap that still counts as chance, as do three deviations of chance.
NOISE = 0.1
#: Rows sampled for each range of ids.
SAMPLE = 64
_FILTER = BITS // 8
_k = np.arange(WINDOW + 1, dtype=np.float64)
#: k log k in 1/64 bit, and what one occurrence more adds to it.
_XLOGX = np.round(64 * np.where(_k > 0, _k * np.log2(np.maximum(_k, 1)), 0.0)).astype(np.int32)
_MORE = np.diff(_XLOGX)
_FULL = int(_XLOGX[WINDOW])


def byte_entropy(buf: np.ndarray) -> np.ndarray:
    """Bin of the byte entropy of every ``WINDOW`` consecutive bytes.

    The sum of k log k over the counts of a window changes by the byte that
    enters and the byte that leaves; how often either occurs in the window is
    counted by comparing the bytes with themselves at each lag.
    """
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (buf[lag:] == buf[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    change = _MORE[before]
    change[WINDOW:] -= _MORE[after[: n - WINDOW]]
    return (_FULL - np.cumsum(change)[WINDOW - 1 :]).astype(np.int64) * (BINS - 1) // _FULL


def features(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, entropy bin) of every window within a text.

    A text shorter than a window is one feature by itself, in bin 0, if it has any bytes.
    """
    size = np.diff(texts.at)
    per = np.where(size >= WINDOW, size - WINDOW + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), per)
    start = np.arange(len(doc)) + np.repeat(texts.at[:-1] - np.cumsum(per) + per, per)
    entropy = np.zeros(len(doc), np.int64)
    whole = size[doc] >= WINDOW
    entropy[whole] = byte_entropy(texts.buf)[start[whole]]
    return start, doc, entropy


def select(start: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices of the features that are rarest of enough of their neighbourhoods, the first of equals.

    A text with hardly more features than a neighbourhood has one neighbourhood, and what is rarest there is selected.
    """
    n = len(rank)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([at, [n]]))
    points = np.zeros(n, np.int64)
    if n >= NEIGHBOURS:
        best, width = rank.astype(np.int64) << 32 | np.arange(n), 1
        while width < NEIGHBOURS:
            step = min(width, NEIGHBOURS - width)
            best = np.minimum(best[: len(best) - step], best[step:])
            width += step
        whole = doc[: n - NEIGHBOURS + 1] == doc[NEIGHBOURS - 1 :]
        points = np.bincount(best[whole] & 0xFFFFFFFF, minlength=n)
    few = size < NEIGHBOURS + POINTS
    if few.any():
        of = np.repeat(np.arange(len(at)), size)
        least = np.minimum.reduceat(rank, at)
        points[few[of] & (rank == least[of])] = POINTS
    return np.flatnonzero(points >= POINTS)


def digests(texts: kernel.Texts, rows: int, ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text, as (filters, 256) bytes; no filters for an empty text."""
    start, doc, entropy = features(texts)
    chosen = select(start, doc, ranks[entropy])
    start, doc = start[chosen], doc[chosen]
    end = np.minimum(start + WINDOW, texts.at[1:][doc])
    h = texts.span_hash(start, end)
    first = np.searchsorted(doc, np.arange(rows + 1))
    nth = np.arange(len(doc)) - first[:-1][doc]
    chains = -(-np.diff(first) // CAPACITY)
    base = np.concatenate([[0], np.cumsum(chains)])
    filters = np.zeros((base[-1], _FILTER), np.uint8)
    row = base[:-1][doc] + nth // CAPACITY
    for k in range(PROBES):
        bit = ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(filters, (row, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return [filters[base[i] : base[i + 1]] for i in range(rows)]


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode("ascii")


def _expected(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that filters with ``a`` and ``b`` bits set share by chance."""
    return a * b / BITS


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1; equal chains, two empty ones too, are at 1."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    total = weight = 0.0
    step = max(1, (1 << 18) // (len(y) * y.shape[1]))
    for i in range(0, len(x), step):
        both = np.bitwise_count(x[i : i + step, None, :] & y[None]).sum(2, dtype=np.int64)
        least = _expected(nx[i : i + step, None], ny[None])
        most = np.minimum(nx[i : i + step, None], ny[None])
        cut = least + np.maximum(NOISE * (most - least), 3 * np.sqrt(least))
        score = np.where(both > cut, (both - least) / np.maximum(most - least, 1e-9), 0.0).max(axis=1)
        total += float((score * nx[i : i + step]).sum())
        weight += float(nx[i : i + step].sum())
    return min(1.0, total / weight)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of every entropy bin, 0 the rarest, from the features of the whole corpus."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for _, _, texts in kernel.chunks(b.column(0)):
                total += np.bincount(features(texts)[2], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    counts = docs.select(text_col).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect()
    n = np.zeros(BINS, np.int64)
    for b, c in counts:
        n[b] = c
    ranks = np.empty(BINS, np.int32)
    ranks[np.lexsort((np.arange(BINS), n))] = np.arange(BINS)
    return ranks


def _edited(text: bytes, chars: int, follower: bytes) -> bytes:
    """``text`` with its last ``chars // 2`` code points replaced by the first as many of ``follower``."""
    half = chars // 2
    t = text.decode("utf-8")
    return (t[: chars - half] + follower.decode("utf-8")[:half]).encode("utf-8")


def _pairs(rows):
    """(row, next row) for consecutive rows of (bucket, extra, id, text); an extra row only follows."""
    last = None
    for row in rows:
        if last is not None and last[0] == row[0] and not last[1]:
            yield last, row
        last = row


def _texts(parts: list[bytes]) -> kernel.Texts:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return kernel.Texts(np.frombuffer(b"".join(parts), np.uint8), at)


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(pairs: list, ranks: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
    ids = [p[0][2] for p in pairs]
    own = [p[0][3] for p in pairs]
    after = [p[1][3] for p in pairs]
    chars = [len(t.decode("utf-8")) for t in own]
    edited = [_edited(t, n, f) for t, n, f in zip(own, chars, after, strict=True)]
    # consecutive documents share a digest: the successor of one is the next
    distinct = {t: None for t in (*own, *edited, *after)}
    texts = list(distinct)
    chain = dict(zip(texts, digests(_texts(texts), len(texts), ranks), strict=True))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, id_type), pa.array(chars, pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
        pa.array([encode(chain[t]) for t in own]), pa.array([encode(chain[t]) for t in edited]),
        pa.array([likeness(chain[t], chain[e]) for t, e in zip(own, edited, strict=True)]),
        pa.array([likeness(chain[t], chain[f]) for t, f in zip(own, after, strict=True)]),
    ], names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _descending(key, cuts: list, low: int, high: int):
    """The range of ``key``, ``low`` to ``high``, by binary search in ``cuts`` (descending)."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key > cuts[mid], _descending(key, cuts, low, mid)).otherwise(_descending(key, cuts, mid + 1, high))


def with_successors(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, extra, _id, text): every document in the bucket of its id's range, and at its end the next bucket's first.

    Documents are ordered by id, descending with nulls last, then by the hash
    of their text, so that rows of one id fall into several ranges too. The
    ranges are cut at quantiles of a sample of about ``SAMPLE`` ids a bucket;
    it bounds what the driver holds, and every row is dealt. The first
    document of each bucket is copied to the bucket before it, the very first
    to the last.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("k", F.struct("_id", F.xxhash64("text").alias("h")))
    id_type = src.schema["_id"].dataType
    value = lambda r: F.struct(F.lit(r[0]).cast(id_type).alias("_id"), F.lit(r[1]).alias("h"))
    nth = max(1, docs.count() // (SAMPLE * buckets))
    picked = F.pmod(F.xxhash64("_id", "k.h"), F.lit(nth)) == 0
    sample = [r[0] for r in src.where(picked).select("k").orderBy(F.col("k").desc()).collect()]
    cuts = [value(k) for k in dict.fromkeys(sample[i * len(sample) // buckets] for i in range(1, buckets))] if sample else []
    dealt = src.withColumn("bucket", _descending(F.col("k"), cuts, 0, len(cuts)))
    heads = {r[0]: r[1] for r in dealt.groupBy("bucket").agg(F.max("k")).collect()}  # at most ``buckets`` rows
    if not heads:
        return dealt.select("bucket", F.lit(False).alias("extra"), "_id", "text")
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the first bucket's head follows the last bucket
    first = F.array(*[value(heads.get(b, heads[order[0]])) for b in range(order[-1] + 1)])
    home = F.array(*[F.lit(before.get(b, b)) for b in range(order[-1] + 1)])
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    other = F.struct(F.get(home, "bucket").alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.get(first, "bucket").eqNullSafe(F.col("k")), F.array(own, other)).otherwise(F.array(own))
    return dealt.select(F.inline(places), "_id", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Digest of every text and of its edited text, and how alike they and the successor's are.

    The successor of a document is the next in descending order of id, of the
    last the first; null ids come last, and rows of one id follow each other by
    a hash of their texts. The edited text has the last half of the code points
    (rounded down) replaced by the first as many of the successor's, or all it
    has. Returns the id, ``n_chars``, ``edited_sha256``, ``fingerprint`` and
    ``edited_fingerprint`` (base64 of the chained filters, empty for an empty
    text), ``near_edited`` and ``near_next``. A null text counts as empty, a
    very long text is a longer chain; the only document is its own successor;
    an empty table gives an empty result; ids are of any type with an order;
    repeated rows follow each other; other columns are not read, whatever
    their names.

    Text is shuffled once, by ranges of ids, one range a task. The corpus
    counts and the ranges are computed while the plan is built.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = rarity(docs, text_col)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_successors(docs, id_col, text_col, n)
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        def records():
            nonlocal kind
            for b in batches:
                kind = b.column(2).type
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), strict=True)

        kind, ready, size = None, [], 0
        for pair in _pairs(records()):
            ready.append(pair)
            size += len(pair[0][3])
            if size >= kernel.CHUNK:
                yield _emit(ready, ranks, kind)
                ready, size = [], 0
        if ready:
            yield _emit(ready, ranks, kind)

    dealt = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("_id").desc_nulls_last(), F.xxhash64("text").desc(), "text")
    return dealt.mapInArrow(run, f"_id {id_type}, {OUT}").withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: digests of all ``documents`` and their edited texts."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
