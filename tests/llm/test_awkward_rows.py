"""Repeated ids, null ids and structured texts, where hashes and keys could mislead."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from larkspan.llm import outliers, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def awkward():
    """(id, text): ids that repeat over different texts, null ids, texts of Thue-Morse words."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(50)]
    unique = lambda n: [word() for _ in range(n)]
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [
        (1, " ".join(unique(50))), (1, " ".join(unique(10) + passage)), (2, " ".join(passage + unique(10))),
        (None, " ".join(unique(3) + passage)), (None, " ".join(unique(60))), (None, None), (None, None), (3, ""),
        (4, " ".join([x] + passage[:17] + [x] * 20)), (5, " ".join([y] + passage[:17] + [y] * 20)),
        (6, " ".join(["same"] * 100)), (7, " ".join(["same"] * 35)), (8, " ".join(["one", "two"] * 40)),
        (9, " ".join(unique(40))), (9, " ".join(unique(40))), (10, "copy " * 40), (10, "copy " * 40), (11, "short"), (11, "short"),
    ]
    rows += [(12, " ".join(passage[5:20] + unique(30) + passage[:34]))]
    return rows


def removed(rows, window=35):
    starts = Counter()
    for _, t in rows:
        w = WORD.findall(t or "")
        starts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_spans(spark, kind):
    rows = [(None if i is None else i if kind == "long" else f"d{i}", t) for i, t in awkward()]
    out = substrings.repeated_spans(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)).collect()
    order = lambda r: (str(r[0]), *r[1:])
    assert sorted((tuple(r[:4]) for r in out), key=order) == sorted(removed(rows), key=order)
    for r in out:
        assert all(f["end"] - f["first"] >= 35 for f in r["factors"])
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]


def test_statistics_of_structured_lines(spark):
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, f"{x}\n{y}\n{x}"), (2, f"{x}\n{y}"), (3, " ".join([x] * 8 + [y] * 8)), (4, " ".join(([x] * 4 + [y] * 4) * 3))]
    out = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in outliers.robust_outliers(
        spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")).collect()}
    assert out == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 24)}


def cells(points):
    points = np.array(points, float)
    return outliers.Cells(np.ones(len(points)), points, np.zeros((len(points), 5, 5)))


def test_mcd_finds_the_half_of_least_determinant():
    rng = np.random.default_rng(1)
    for n in (8, 10, 12):
        for trial in range(4):
            p = rng.normal(size=(n, 5)) * 0.2 + [5, 1.6, 0, 0, 0]
            p[: n // 4] += 3
            c = cells(p)
            _, _, got, share = outliers.mcd(c, starts=200)
            assert share.sum() == c.half and set(share) <= {0.0, 1.0}
            noise = np.diag(outliers.grain(np.expm1(c.median(0)), np.exp(c.median(1))) ** 2)
            best = min(
                np.linalg.slogdet(outliers.HALF_FACTOR * np.cov(p[list(s)].T, bias=True) + noise)[1]
                for s in combinations(range(n), int(c.half))
            )
            assert got == pytest.approx(best, abs=1e-9)


def test_concentration_decides():
    """Outliers in the middle of every single statistic, off the line that two of them share, are found by the steps alone."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=160)
    good = np.stack([5 + x, 1.6 + 0.3 * x + rng.normal(size=160) * 0.01, *np.zeros((3, 160))], 1)
    y = rng.normal(size=40) * 0.05
    bad = np.stack([5 + y, 1.85 - y, *np.zeros((3, 40))], 1)
    c = cells(np.concatenate([good, bad]))

    def far(steps):
        m, cov, _, _ = outliers.mcd(c, steps=steps)
        d = c.mean - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) > outliers.CHI2_CUT

    assert far(100)[160:].all() and not far(100)[:160].any()
    assert not far(0)[160:].all()


def test_cells_of_any_size_give_the_same_moments(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    v = rng.integers(-500, 3000, size=(400, 5))
    df = spark.createDataFrame([("a", "b", *map(int, r)) for r in v], "_k1 string, _k2 string, _x0 long, _x1 long, _x2 long, _x3 long, _x4 long")
    for most in (1, 50, 10_000):
        old, outliers.CELLS = outliers.CELLS, most
        try:
            got = outliers._cells(df).withColumns({
                "s": F.expr("_c1 * power(2, _level) * _n + _t1"),
            }).agg(F.count("*"), F.sum("_n"), F.sum("s")).first()
        finally:
            outliers.CELLS = old
        assert got[1] == 400 and got[2] == v[:, 1].sum() and (most == 10_000 or got[0] <= 2 * most + 32)


def test_groups_of_one_document_have_a_verdict(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(("alpha", "beta", "gamma", "delta", "eps")) for _ in range(rnd.randint(60, 120)))
    rows = [(i, text(), "en", f"s{i}") for i in range(60)] + [(100, text().replace(" ", " ### "), "en", "odd"), (101, text(), None, None), (None, text(), "en", "s1")]
    out = outliers.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    got = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == 63 and got.pop(100) is False
    assert all(got.values())
