"""The stored postings index against the same scores computed plainly, through changes, and the store below it."""

import math
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import postings as po
from larkspan.operators.store import Conflict, Store

FIELDS = {"path": 3.0, "text": 1.0}


def tokens(text):
    low = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
    return re.findall(r"[^\W_]+", low)


def brute(rows, queries, k, accept=lambda r: True, group=lambda r: None):
    """{query: {group: [(id, score)]}} of rows (id, path, text, lang)."""
    toks = {r[0]: (tokens(r[1]), tokens(r[2])) for r in rows}
    dl = {i: len(a) + len(b) for i, (a, b) in toks.items()}
    avg = sum(dl.values()) / len(dl)

    def frequency(i, parts):
        return sum(w * sum(t[j : j + len(parts)] == parts for j in range(len(t) - len(parts) + 1)) for w, t in zip((3.0, 1.0), toks[i], strict=True))

    out = {}
    for q, terms in queries:
        score = {}
        for parts in [tokens(t) for t in dict.fromkeys(terms)]:
            f = {i: frequency(i, parts) for i in toks} if parts else {}
            n = sum(x > 0 for x in f.values())
            idf = max(math.log((len(toks) - n + 0.5) / (n + 0.5)), 0) or 1e-6
            for i, x in f.items():
                if x:
                    score[i] = score.get(i, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl[i] / avg))
        found = {}
        for r in rows:
            if r[0] in score and accept(r):
                found.setdefault(group(r), []).append((r[0], round(score[r[0]], 6)))
        if found:
            out[q] = {g: sorted(x, key=lambda p: (-p[1], p[0]))[:k] for g, x in found.items()}
    return out


def got(store, spark, queries, k, **options):
    q = spark.createDataFrame(queries, "query_id string, terms array<string>")
    out: dict = {}
    for r in sorted(po.search(store, q, k, **options).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], {}).setdefault(r[options["group"]] if "group" in options else None, []).append((r["doc_id"], round(r["score"], 6)))
    return out


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 60)))
        rows.append((f"d{i:04}", f"dir_{i % 7}/w{i % 50}.txt", text + rnd.choice(["", " Éclair_au lait", " snake_case here", " rare" + str(i)]), rnd.choice(["en", "fr"])))
    rows += [("e1", "x", None, "en"), ("e2", None, "", "fr"), ("e3", "...", "!!!", "en")]
    return rows


QUERIES = [
    ("common", ["w0", "w1"]), ("mixed", ["w0", "w40", "w59"]), ("rare", ["rare7", "w0", "w1", "w2"]), ("phrase", ["snake_case", "w3"]), ("accent", ["Éclair", "eclair"]),
    ("none", ["absent"]), ("empty", []), ("signs", ["__"]), ("twice", ["w5", "W5", "w5"]), ("long", [f"w{i}" for i in range(24)]), ("repeated phrase", ["w0_w0"]),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, path string, text string, lang string")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("index")))
    po.update(s, frame(spark, corpus()), FIELDS, keep=("lang",), shard_docs=90, buckets=4)
    return s


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search_equals_plain_scores(store, spark, k):
    assert got(store, spark, QUERIES, k) == brute(corpus(), QUERIES, k)


def test_filters_and_groups(store, spark):
    assert got(store, spark, QUERIES, 4, accept=F.col("lang") == "fr") == brute(corpus(), QUERIES, 4, accept=lambda r: r[3] == "fr")
    assert got(store, spark, QUERIES, 3, group="lang") == brute(corpus(), QUERIES, 3, group=lambda r: r[3])


def test_many_queries_are_searched_in_slices(store, spark, monkeypatch):
    monkeypatch.setattr(po, "SENT_TERMS", 6)
    assert got(store, spark, QUERIES, 3) == brute(corpus(), QUERIES, 3)


def files(where):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(where) for f in names}


def test_changes_file_by_file(spark, tmp_path):
    """Replaced, removed and new documents; older generations are not touched; compaction keeps the scores."""
    s = Store(spark, str(tmp_path))
    rows = corpus()
    first = po.update(s, frame(spark, rows), FIELDS, keep=("lang",), shard_docs=90, buckets=4)
    before = files(tmp_path)
    new = corpus(seed=9)
    changed = [new[i] for i in (3, 50, 51)] + [("n1", "new", "w0 w1 snake case brand new", "en"), ("e1", "x", "now w40", "fr")]
    removed = ["d0007", "e2", "missing"]
    po.update(s, frame(spark, changed), FIELDS, keep=("lang",), removed=spark.createDataFrame([(i,) for i in removed], "doc_id string"), shard_docs=90)
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())
    written = sum(os.path.getsize(f) for f in after if f not in before and "postings" in f and f.endswith(".parquet"))
    assert written < 0.5 * sum(os.path.getsize(f) for f in before if "postings" in f and f.endswith(".parquet"))
    now = {r[0]: r for r in rows} | {r[0]: r for r in changed}
    live = [r for i, r in now.items() if i not in removed]
    queries = [*QUERIES, ("new", ["brand_new", "rare7"])]
    assert got(s, spark, queries, 6) == brute(live, queries, 6)
    assert got(s, spark, queries, 6, accept=F.col("lang") == "fr") == brute(live, queries, 6, accept=lambda r: r[3] == "fr")
    # the state of before is still there to be read
    assert got(s, spark, QUERIES, 3, state=first) == brute(rows, QUERIES, 3)
    po.update(s, frame(spark, rows[:5]), FIELDS, keep=("lang",), shard_docs=90)
    live = [r for r in live if r[0] not in {x[0] for x in rows[:5]}] + rows[:5]
    assert got(s, spark, queries, 6, group="lang") == brute(live, queries, 6, group=lambda r: r[3])
    po.compact(s, shard_docs=90)
    assert "dead" not in s.current()["tables"] and got(s, spark, queries, 6) == brute(live, queries, 6)
    assert s.vacuum() > 0 and got(s, spark, queries, 6) == brute(live, queries, 6)


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    """A rare strong term, and a common weak one that only matters where the rare one has a block."""
    s = Store(spark, str(tmp_path))
    rows = [(f"d{i:05}", "p", "the cat " + "needle " * (3 if i % 400 == 0 else 0) + "filler " * (i % 5), "en") for i in range(4000)]
    po.update(s, frame(spark, rows), FIELDS, shard_docs=200, buckets=4)
    queries = [("q", ["the", "needle"])]
    heads = s.read("postings").where("term IN ('the', 'needle')")
    n = len(rows)
    idf = np.array([math.log((n - 10 + 0.5) / 10.5), 1e-6])
    facts = s.current()["facts"]
    plan = po.Plan([[1, 0]], idf, facts["length"] / facts["n_docs"], 3)
    need = po.needed_blocks(heads.select("gen", "shard", "term", "block", "first", "last", "max_f", "min_dl", "best_f", "best_dl"), plan, ["needle", "the"])
    all_ = dict(heads.groupBy("term").count().collect())
    read = dict(need.groupBy("term").count().collect())
    assert read["needle"] == all_["needle"] and read["the"] < 0.7 * all_["the"]
    assert got(s, spark, queries, 3) == brute(rows, queries, 3)


def test_closed_terms_add_to_what_is_there_alone():
    """A weak term's postings are added only where the strong term has put documents within reach."""
    n, rnd = 1000, np.random.default_rng(2)
    strong, weak = np.arange(0, 1000, 100), np.arange(1000)
    gains = [1 + rnd.random(10), rnd.random(1000)]
    plan = po.Plan([[0, 1]], np.array([5.0, 0.01]), 1.0, 4)
    blocks = [strong] + [weak[i : i + 128] for i in range(0, 1000, 128)]
    parts = [gains[0]] + [gains[1][i : i + 128] for i in range(0, 1000, 128)]
    out, added = po.score_shard(plan, np.array([0] + [1] * 8), blocks, parts, np.zeros(n, int), n)
    full = np.zeros(n)
    full[strong] += 5 * gains[0]
    full += 0.01 * gains[1]
    want = np.lexsort((np.arange(n), -np.round(full, 6)))[:4]
    assert [p for _, p, _ in out] == want.tolist() and np.allclose([s for *_, s in out], full[want]) and added <= 20


def test_an_overtaken_writer_fails_without_effect(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    base, gens = s.current(), [s.generation(), s.generation()]
    for i, g in enumerate(gens):
        s.write("t", g, spark.range(i + 1))
    s.commit(base, {"t": gens[0]}, facts={"a": 1}, batch=("src", 4))
    with pytest.raises(Conflict):
        s.commit(base, {"t": gens[1]})
    assert s.read("t").count() == 1 and s.current()["version"] == 1 and s.seen("src", 4) and not s.seen("src", 5) and not s.seen("other", 0)
    s.commit(s.current(), {"t": gens[1]})
    assert s.read("t").count() == 3 and s.current()["facts"] == {"a": 1} and s.read("t", s.current(1)).count() == 1
    s.write("t", s.generation(), spark.range(50))  # a killed writer's rows
    assert s.read("t").count() == 3 and s.vacuum() == 1 and s.read("t").count() == 3 and s.read("nothing") is None
