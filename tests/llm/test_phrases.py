"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspan.llm import kernel, phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows):
    f, n = counted(rows)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= 30}
    out = []
    for (lang, *w), a in candidates.items():
        if any(
            x[0] == lang and len(x) > len(w) + 1 and 100 * b >= 80 * a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1))
            for x, b in candidates.items()
        ):
            continue
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    rank, final = Counter(), []
    for lang, s, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        final.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(x for x in final if x[1] <= 2000)


def texts():
    rnd, rows = random.Random(1), []
    for lang in ("en", None, "und", "de"):
        word = [f"{lang}{k}" for k in range(30)] + ["Ünder", "ÀB", "x" * 50]
        for _ in range(60):
            t = ""
            for _ in range(rnd.randrange(40)):
                t += rnd.choice(["New York City ", "new  york\t", "a b a b ", "one two, ", "one two three four\n", "of the ", rnd.choice(word) + rnd.choice(" \t.;!?\r\x0b:,")])
            rows.append((t, lang))
    rows += [(None, "en"), ("", "en"), (" .,\n", None), ("same words again here", "en")] + [("a repeated row of words", "fr")] * 40
    rows += [("word " * 5000, "de"), ("x" * 30000 + " " + "y", "de")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("k", "n", "f", "seed", "block", "cells", "phrase", "score", "rank", "lane")
    schema = "text string, lang string, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in texts()], schema).repartition(5)


def got(df, **options):
    out = phrases.collocations(df, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def test_against_a_plain_count(docs):
    want = brute(texts())
    assert got(docs) == want and len({r[0] for r in want}) >= 3


def test_only_the_first_are_given(docs):
    assert got(docs, most=3) == [r for r in brute(texts()) if r[1] <= 3]


def test_a_crowded_sketch_loses_nothing(docs, monkeypatch):
    """Cells shared by hundreds of n-grams, a task's sketch sent in many parts, texts cut into short pieces."""
    monkeypatch.setattr(phrases, "LEAST_CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "MOST_CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "HELD", 64)
    monkeypatch.setattr(phrases, "CHUNK", 100)
    assert got(docs) == brute(texts())


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("", "en")], [("too few words", "en")]):
        assert got(spark.createDataFrame(rows, "text string, lang string")) == []


@pytest.mark.parametrize("limit", [5, 17, 40, 1000])
def test_long_texts_are_cut_between_phrases(limit):
    """Every n-gram of a text is counted once, however it is cut."""
    for text in ("a b c d e f g h i j k l m n o p", "one, two three. four five six seven eight nine ten eleven", "x" * 60 + " y z " + "w" * 45, "   \n", "word", "a  b\t\tc  d. e"):
        buf = np.frombuffer(text.encode(), np.uint8)
        n = Counter()
        for a, b, context in phrases.segments(buf, limit):
            part = kernel.Texts(buf[a:b], np.array([0, b - a]))
            g = phrases.Grams(part, np.zeros(1, np.uint64), context)
            bits = [np.full(phrases.ROWS * 1024 // 8, 255, np.uint8)] * 2
            for rows in phrases.count_passing(g, pa.array(["en"]), bits, 1024):
                for _, k, p, c in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                    n[("en", *p.split(" "))] += c if k else 0
        f, _ = counted([(text, "en")])
        assert +n == f


def test_cells_below_the_threshold_stop_a_phrase():
    buf = np.frombuffer(b"a b a b", np.uint8)
    g = phrases.Grams(kernel.Texts(buf, np.array([0, 7])), np.zeros(1, np.uint64))
    none = [np.zeros(phrases.ROWS * 1024 // 8, np.uint8)] * 2
    assert [r.num_rows for r in phrases.count_passing(g, pa.array(["en"]), none, 1024)] == [1]  # the number of words alone


def test_products_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, whole = 7 * 10**18, 7 * 10**18 + 9 * 10**18
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(7 * 10**18).alias("l"), F.lit(9 * 10**18).alias("r"))
    assert row.select(phrases.score("a", F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))).first()[0] == 2000000 * a // whole


def test_sketch_blocks_keep_low_and_high_bytes_apart():
    """Blocks come back as they were, in fewer bytes than with the two bytes of a step side by side."""
    import zstandard

    rnd = np.random.default_rng(3)
    at = np.unique(rnd.integers(0, 3 * phrases.BLOCK, 9000)).astype(np.uint32)
    n = np.minimum(rnd.geometric(0.6, len(at)), phrases.MIN_COUNT).astype(np.uint8)
    packed = phrases._pack(at, n)
    got = [(b * phrases.BLOCK + phrases._unpack(d)[0].astype(np.int64), phrases._unpack(d)[1]) for b, d in zip(*(c.to_pylist() for c in packed.columns), strict=True)]
    assert np.array_equal(np.concatenate([a for a, _ in got]), at) and np.array_equal(np.concatenate([m for _, m in got]), n)
    plain = 0
    for b, _ in zip(*(c.to_pylist() for c in packed.columns), strict=True):
        some = at // phrases.BLOCK == b
        step = np.diff((at[some] % phrases.BLOCK).astype(np.uint16), prepend=np.uint16(0))
        plain += len(zstandard.ZstdCompressor(level=1).compress(step.tobytes() + n[some].tobytes()))
    assert sum(len(d) for d in packed.column(1).to_pylist()) < 0.95 * plain


def test_languages_with_line_breaks_stay_apart(spark):
    rows = [("a b " * 40, "x"), ("a b " * 40, "x\ny"), ("a b " * 40, "\n")]
    got = phrases.frequent(spark.createDataFrame(rows, "text string, lang string")).collect()
    want, _ = counted(rows)
    assert {(r["lang"], *r["phrase"].split(" ")): r["f"] for r in got if r["k"]} == {p: f for p, f in want.items() if f >= 30}
    assert all(r["k"] == len(r["phrase"].split()) for r in got)
