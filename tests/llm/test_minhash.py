"""Circulant MinHash against brute-force Jaccard 0.8 over four-word shingles."""

import random
import re

import numpy as np
import pytest

from larkspan.llm import linking, minhash, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(id, n_shingles, component, kept) of every (id, text), sorted."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and group[i] != group[j] and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    # a row without words is its own component, also where its id repeats
    return sorted(((i, len(s), least.get(g), i == least.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def check(spark, rows, kind="long", extra=()):
    columns = ", ".join(["", *(f"`{c}` string" for c in extra)])
    df = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id {kind}, text string{columns}").repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    return got


def family(rnd, size, edits):
    base = [f"W{rnd.randrange(10**6)}" for _ in range(size)]
    for n in edits:
        w = list(base)
        for _ in range(n):
            w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
        yield " ".join(w)


def test_the_query_on_a_whole_table(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.QUERIES["op13_circulant_minhash"](spark, data)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_families_nulls_repeated_rows_and_clashing_names(spark, kind):
    rnd, texts = random.Random(7), []
    for size in (3, 4, 5, 8, 30, 100, 400, 3000):
        texts += family(rnd, size, [min(e, size) * max(1, size // 200) for e in (0, 0, 1, 1, 2, 2, 3, 4, 5, 8)])
    texts += [None, "", " \n", "one", "ONE", "one one", None, ""]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[3]), (None, None), (None, "alone and without an id here"), (5, texts[7]), (5, texts[7]), (5, "")]
    rows = [(i if i is None or kind == "long" else f"d{i:04}", t) for i, t in rows]
    got = check(spark, rows, kind, ("_id", "r1", "r2", "k1", "k2", "size", "p", "post", "node", "group", "s", "u", "v"))
    assert 10 < len({r[2] for r in got}) < len(rows) - 20


def test_a_chain_is_one_component_and_a_hot_set_has_one_node(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    chain = [" ".join(words[k * 8 : k * 8 + 120]) for k in range(22)]  # neighbours are similar, ends are not
    rows = list(enumerate(chain)) + [(100 + k, chain[4]) for k in range(60)]
    assert {r[2] for r in check(spark, rows)} == {0}


def test_lists_that_hold_several_components(spark):
    """Sets below 0.8 that share bands: hubs are of other components, so the lists are joined with themselves."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(8):  # eight families of one template, about 0.6 alike
        own = list(base)
        for k in range(0, 200, 28):
            own[k] = f"f{rnd.randrange(10**6)}"
        texts += [" ".join(own[: 200 - 2 * e]) for e in range(4)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    got = check(spark, list(zip(order, texts, strict=True)))
    assert len({r[2] for r in got}) == 8


def test_empty_table(spark):
    out = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_coordinates_are_one_permutation_shifted():
    rnd = np.random.default_rng(1)
    hashes, at = rnd.integers(0, 1 << 63, 50).astype(np.uint64), np.array([0, 20, 20, 50])
    sig = minhash.signatures(hashes, at, 7)
    for k in range(7):
        for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want = min((int(minhash.order(minhash.scatter(hashes[x : x + 1]) + np.uint64(k))[0]) for x in range(i, j)), default=0)
            assert int(sig[k, s]) == want


def test_agreement_of_coordinates_estimates_jaccard():
    rnd = np.random.default_rng(4)
    both, a, b = (rnd.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    sig = minhash.signatures(np.concatenate([both, a, both, b]), np.array([0, 900, 1800]), 512)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 0.8) < 0.06


def test_keys_of_sets_are_128_bits():
    hashes = np.arange(1, 7, dtype=np.uint64)
    k1, k2 = linking.keys(hashes, np.array([0, 2, 4, 4, 6]))
    assert len(set(zip(k1.tolist(), k2.tolist(), strict=True))) == 4 and (k1[2], k2[2]) == (0, 0)
