"""The pipeline's near-dedup stage against brute-force Jaccard 0.8 over five-word shingles."""

import random
import re

import pyarrow as pa

import corpus_pipeline
from larkspan.llm import jaccard
from larkspan.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(texts):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert dict(map(tuple, jaccard.near_duplicates(docs).collect())) == want
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(want.values()))
    return want


def test_copies_with_a_few_other_words_are_one_group(spark):
    rnd = random.Random(5)
    texts, n = {}, 0
    for size in (3, 4, 5, 6, 30, 100, 300):
        base = [f"W{rnd.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 8, 10, 12):
            w = list(base)
            for _ in range(edits * size // 300 if size == 300 else min(edits, 2 + size // 50)):
                w[rnd.randrange(size)] = f"x{rnd.randrange(10**6)}"
            texts[n] = " ".join(w)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: " \n", n + 3: "one", n + 4: "ONE", n + 5: "one one"}
    want = check(spark, texts)
    assert len(set(want.values())) < len(texts) - 10


def test_the_stage_finds_every_pair_of_the_table(spark, data):
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    want = check(spark, texts)
    assert want[177] == 1 and want[145] == 6


def test_simhash_gives_pairs_of_its_own(spark, monkeypatch):
    """Near copies within op2's three bits are linked by its grids even where the shared shingles give no pair; what is not alike is not."""
    from pyspark.sql import functions as F

    from larkspan.llm import kernel, linking, simhash

    rnd = random.Random(8)
    texts = {}
    for n in range(12):
        words = [f"W{rnd.randrange(10**6)}" for _ in range(600)]
        texts[2 * n] = " ".join(words)
        words[rnd.randrange(600)] = "other"
        texts[2 * n + 1] = " ".join(words)
    _, _, batch = next(kernel.chunks(pa.chunked_array([pa.array(list(texts.values()))]).combine_chunks()))
    h, at = linking.shingle_sets(batch, jaccard.WORDS)
    fp = [int(x) for x in simhash.of_sets(h, at)]
    for i in range(len(texts)):
        some = [int(x) for x in h[at[i] : at[i + 1]]]
        assert fp[i] == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in some) > len(some))
    near = [i for i in range(0, 24, 2) if (fp[i] ^ fp[i + 1]).bit_count() <= 3]
    assert near
    monkeypatch.setattr(jaccard, "_sizes_fit", lambda a, b, i, j: F.lit(False))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = dict(map(tuple, jaccard.near_duplicates(docs).collect()))
    assert got == {i: i - 1 if i - 1 in near else i for i in texts}


def test_what_grids_and_hubs_bring_together_is_verified_at_once(spark, monkeypatch):
    rnd = random.Random(11)
    texts, rounds, sets = {}, [], jaccard.linking.wanted_sets
    for base in range(6):  # some copies that the grids find, others that only shared shingles find
        w = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        for edits in (0, 1, 6):
            at = rnd.sample(range(0, 300, 5), edits)
            texts[len(texts)] = " ".join(f"x{base}{edits}{k}" if k in at else x for k, x in enumerate(w))
    monkeypatch.setattr(jaccard.linking, "wanted_sets", lambda *a: rounds.append(a) or sets(*a))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = dict(map(tuple, jaccard.near_duplicates(docs).collect()))
    assert found == brute(texts) and set(found.values()) == set(range(0, 18, 3))
    assert len(rounds) <= 2  # the other round is of what only lists of several components bring together
