"""Digests against plain versions: entropy, selection, filters, likeness, successors."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from larkspan.llm import digests


def prints(*texts):
    x = digests._texts([t.encode() for t in texts])
    return digests.digests(x, len(texts), np.arange(digests.BINS, dtype=np.int32))


def test_unspaced_texts_that_share_their_first_window():
    rnd = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789+/", [chr(c) for c in range(0x4E00, 0x5600)]):
        a, b, tail = ("".join(rnd.choice(letters) for _ in range(3000)) for _ in range(3))
        a, b = "".join(letters[:32]) + a, "".join(letters[:32]) + b
        half = a[: len(a) // 2] + tail[: len(a) // 2]
        x, y, z = prints(a, b, half)
        assert digests.likeness(x, y) < 0.2
        assert 0.2 < digests.likeness(x, z) < 0.9


def slow_features(text):
    raw, w = text.encode(), digests.WINDOW
    if len(raw) < w:
        return [(0, 0)] if raw else []
    out = []
    for i in range(len(raw) - w + 1):
        s = sum(int(digests._XLOGX[c]) for c in Counter(raw[i : i + w]).values())
        h = sum(c / w * math.log2(w / c) for c in Counter(raw[i : i + w]).values())
        bin_ = (digests._FULL - s) * (digests.BINS - 1) // digests._FULL
        assert abs(bin_ / (digests.BINS - 1) - h / math.log2(w)) < 0.01
        out.append((i, bin_))
    return out


def slow_digest(text, rank):
    f, m = slow_features(text), digests.NEIGHBOURS
    points = Counter()
    for i in range(len(f) - m + 1):
        points[min(range(i, i + m), key=lambda k: (rank[f[k][1]], k))] += 1
    if 0 < len(f) < m + digests.POINTS:
        least = min(rank[b] for _, b in f)
        points = {k: digests.POINTS for k, (_, b) in enumerate(f) if rank[b] == least}
    chosen = [f[k][0] for k in sorted(points) if points[k] >= digests.POINTS]
    raw, chain = text.encode(), []
    for nth, at in enumerate(chosen):
        if nth % digests.CAPACITY == 0:
            chain.append(bytearray(digests.BITS // 8))
        x = digests._texts([raw[at : at + digests.WINDOW]])
        h = int(x.span_hash(x.at[:1], x.at[1:])[0])
        for k in range(digests.PROBES):
            bit = h >> 11 * k & digests.BITS - 1
            chain[-1][bit >> 3] |= 1 << (bit & 7)
    return [bytes(c) for c in chain]


def test_digests_of_awkward_texts():
    rnd = random.Random(4)
    rank = np.array(rnd.sample(range(digests.BINS), digests.BINS), np.int32)
    texts = ["", "a", "a" * 31, "a" * 32, "a" * 200, "ab" * 40, "é" * 100, "x y " * 30]
    texts += ["".join(rnd.choice("abcdef \n") for _ in range(n)) for n in (40, 63, 64, 65, 300, 9000)]
    texts += ["".join(chr(rnd.randint(0x4E00, 0x4F00)) for _ in range(200))]
    got = digests.digests(digests._texts([t.encode() for t in texts]), len(texts), rank)
    for t, chain in zip(texts, got, strict=True):
        assert [c.tobytes() for c in chain] == slow_digest(t, rank)
    assert len(got[-2]) > 1


def slow_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    bits = lambda x: int.from_bytes(x).bit_count()
    total = weight = 0.0
    for x in a:
        scores = []
        for y in b:
            both = int.from_bytes(bytes(p & q for p, q in zip(x, y))).bit_count()
            least, most = bits(x) * bits(y) / digests.BITS, min(bits(x), bits(y))
            cut = least + max(digests.NOISE * (most - least), 3 * math.sqrt(least))
            scores.append((both - least) / max(most - least, 1e-9) if both > cut else 0.0)
        total, weight = total + max(scores) * bits(x), weight + bits(x)
    return min(1.0, total / weight)


def test_likeness():
    rnd = random.Random(5)
    a = "".join(rnd.choice("abcdefghij klmnop") for _ in range(9000))
    texts = ["", "z", a, a[:4000], a[:4500] + a[:4000][::-1], a[::-1], a[100:]]
    chains = prints(*texts)
    for x in chains:
        for y in chains:
            assert digests.likeness(x, y) == pytest.approx(slow_likeness([c.tobytes() for c in x], [c.tobytes() for c in y]))


@pytest.mark.parametrize("kind", ["long", "int", "smallint", "string", "date"])
def test_successors_of_any_id(spark, kind):
    rnd = random.Random(6)
    values = [None, None, *(rnd.sample(range(1, 300), 40)), 7, 7]
    rows = [(v, "".join(rnd.choice("abc déf") for _ in range(rnd.randint(0, 120)))) for v in values] + [(7, None)]
    if kind == "string":
        rows = [(v and f"k{v}", t) for v, t in rows]
    df = spark.createDataFrame(rows, f"doc_id {'int' if kind in ('smallint', 'date') else kind}, text string")
    if kind == "smallint":
        df = df.selectExpr("CAST(doc_id AS smallint) AS doc_id", "text")
    if kind == "date":
        df = df.selectExpr("date_add(DATE'2020-01-01', doc_id) AS doc_id", "text")
    df = df.cache()
    from pyspark.sql import functions as F

    order = [(r[0], r[1]) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
             .orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("t").desc(), "t").collect()]
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    for buckets in (1, 3, 9):
        out = digests.compare_with_edits(df, buckets=buckets)
        assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        assert sorted(map(str, (tuple(r[:3]) for r in out.collect()))) == sorted(map(str, want))
