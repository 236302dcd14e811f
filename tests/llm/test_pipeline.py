"""The pipeline's stages, each held against a plain version on what its predecessor kept."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from larkspan.llm import mixing
from larkspan.session import materialize, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, data):
    """The rows after each stage, by name."""
    docs = table(spark, data, "documents")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), name)
        out[name] = docs.collect()
    return out


def test_all_but_the_last_keep_the_columns(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(kept[name][0].asDict()) == COLUMNS


def test_language_id_keeps_documents_with_letters(kept):
    before, after = {r["doc_id"] for r in kept["documents"]}, {r["doc_id"] for r in kept["language_id"]}
    assert after <= before
    for r in kept["documents"]:
        if len(WORD.findall(r["text"] or "")) > 20 and len(re.findall(r"[^\W\d_]", r["text"])) > len(r["text"]) / 2:
            assert r["doc_id"] in after


def test_line_dedup_leaves_no_spread_line_twice(kept):
    holders = defaultdict(set)
    for r in kept["line_dedup"]:
        for line in r["text"].split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(key) >= 40:
                holders[key].add(r["doc_id"])
    assert max(map(len, holders.values())) < 5
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    assert len(kept["line_dedup"]) == len(kept["language_id"])


def test_near_dedup_keeps_one_of_each_group(kept):
    """Against brute-force Jaccard over five-word shingles; the stage's limit is 0.8, not op2's three bits."""
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept["line_dedup"]}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert len({find(i) for i in ids}) < len(ids)
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == sorted({find(i) for i in ids})


def test_mix_takes_the_copies_it_says(spark, kept):
    docs = spark.createDataFrame(kept["near_dedup"])
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in kept["mix"]) == want


def test_bins_hold_everything_once(kept):
    words = Counter()
    for r in kept["mix"]:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    placed, bins = Counter(), defaultdict(list)
    for r in kept["pack"]:
        placed[r["doc_id"]] += r["size"]
        bins[r["bin_id"]].append(r)
    assert +placed == +words
    for b in bins.values():
        assert sum(r["size"] for r in b) <= 2048
        assert len({r["cluster"] for r in b}) == len(b)



def test_run_gives_the_last_stage(spark, data, kept):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect()), key=key) == sorted(map(tuple, kept["pack"]), key=key)
