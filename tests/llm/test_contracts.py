"""Stages and operators on rows whose ids are null or repeat, with columns whose names the operators use themselves."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from larkspan.llm import digests, jaccard, langid, linededup, mixing, outliers, packing, sharding, simhash, substrings, weaklabels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = (
    "_id", "_n", "_copy", "_copies", "_kept", "_runs", "row", "runs", "kept", "r1", "r2", "n", "nth", "group", "copies", "k", "bucket", "extra", "fp",
    "size", "hash", "pos", "part", "line", "key", "source_size", "target", "i", "l", "t", "h", "o", "words", "cluster", "piece", "start", "shard", "_h", "_lane",
)
LINE = "a line that is long enough to be counted in this and that document"


def rows(kind):
    """(id, text, lang, source): repeated ids over different texts, null ids, repeated rows, ties, empty, null and long texts."""
    a = "the first of several texts about nothing in particular that anyone would care to read twice in a day or so"
    b = "quite another sequence of words to say nothing at all about anything anywhere with many more words at the end"
    long = " ".join(f"word{i}" for i in range(5000))
    out = [
        (1, a, "en", "x"), (1, b, "en", "x"), (None, a, "en", "y"), (None, a, "en", "y"), (2, a, "en", "x"), (3, None, "en", "x"), (3, None, "en", "x"),
        (4, "", None, None), (5, b + " indeed", "en", "y"), (6, long, "en", "x"), (7, "1 2 3 %%", "en", "y"), (None, None, None, None), (8, b, "en", None),
    ]
    out += [(20 + i, f"{LINE}\nunique {i} line of document number {i} here", "en", "xyz"[i % 3]) for i in range(6)]
    out += [(20, f"{LINE}\nthe other text of this id stands here", "en", "x"), (None, f"{LINE}\nno id", "en", "x")]
    return [(None if i is None else i if kind == "long" else f"d{i:03}", *r) for i, *r in out]


@pytest.fixture(scope="module", params=["long", "string"])
def docs(request, spark):
    kind = request.param
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(i, t, lang, s, len(t or ""), *(f"{c}!" for c in CLASHING)) for i, t, lang, s in rows(kind)]
    return spark.createDataFrame(data, f"doc_id {kind}, text string, lang string, source string, n_chars int, {extra}").repartition(3).cache()


def key(r):
    return tuple(map(str, r))


def four(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=key)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(docs, spark, name, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert all(r[c] == f"{c}!" for r in out.collect() for c in CLASHING)
    assert stage(spark, docs.drop("n_chars"), "").columns == docs.drop("n_chars").columns
    assert stage(spark, docs.where("false"), "").count() == 0


def test_language_id_drops_what_has_no_letters(docs, spark):
    want = [r for r in four(docs) if re.search("[a-z]", r[1] or "")]
    assert four(corpus_pipeline.language_id(spark, docs, "")) == want


def test_line_dedup_cuts_each_text_by_itself(docs, spark):
    largest = max(r[0] for r in four(docs) if r[0] is not None and LINE in (r[1] or ""))
    want = [(i, t if t is None or i is None or i == largest else t.replace(LINE + "\n", ""), lang, s) for i, t, lang, s in four(docs)]
    assert four(corpus_pipeline.line_dedup(spark, docs, "")) == sorted(want, key=key)


def test_near_dedup_keeps_one_row_of_each_group(docs, spark):
    def shingles(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    all_ = four(docs)
    group = list(range(len(all_)))
    for i, x in enumerate(all_):
        for j in range(i):
            p, q = shingles(x[1]), shingles(all_[j][1])
            if 9 * len(p & q) >= 4 * (len(p) + len(q)):
                group = [group[j] if g == group[i] else g for g in group]
    out = four(corpus_pipeline.near_dedup(spark, docs, ""))
    assert len(out) == len(set(group))
    assert sorted(group[all_.index(r)] for r in out) == sorted(set(group))
    for r in out:  # the smallest id of its group, nulls last
        ids = [all_[i][0] for i in range(len(all_)) if group[i] == group[all_.index(r)]]
        assert r[0] == min((i for i in ids if i is not None), default=None)


def test_mix_gives_what_copies_says(docs, spark):
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in four(mixing.mix(docs)))
    assert got == +want and got


def test_pack_gives_every_row_its_places(docs, spark):
    places = packing.pack_texts(docs, capacity=500).collect()
    got, want = Counter(), Counter()
    for r in places:
        got[r["doc_id"]] += r["size"]
        assert len(WORD.findall(r["text"] or "")) == r["size"]
    for i, t, *_ in four(docs):
        want[i] += len(WORD.findall(t or ""))
    assert +got == +want and len({r["bin_id"] for r in places}) > 5
    assert sorted(map(key, places)) == sorted(map(key, packing.pack_texts(docs.repartition(2, "text"), capacity=500).collect()))


OPERATORS = {
    "outliers": outliers.robust_outliers, "simhash": simhash.near_duplicates, "jaccard": jaccard.near_duplicates,
    "langid": lambda d: langid.predict(d, langid.fit(d)), "copies": mixing.copies, "shards": sharding.shard_documents,
    "digests": digests.compare_with_edits, "labels": weaklabels.classify, "spans": substrings.repeated_spans,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_answer_every_row(docs, name):
    """A row for every row, with its id; other columns, whatever their names, change nothing."""
    out = OPERATORS[name](docs)
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = sorted(map(key, out.collect()))
    assert Counter(r[0] for r in got) == Counter(str(r[0]) for r in four(docs))
    assert got == sorted(map(key, OPERATORS[name](docs.select("doc_id", "text", "lang", "source")).collect()))


def test_components_over_null_and_repeated_ids(docs):
    out = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    one, five, eight = sorted({r[0] for r in four(docs) if r[0] is not None})[0], *(x for x in {r[0] for r in four(docs)} if x in (5, 8, "d005", "d008"))
    assert out[None, one] == 2  # both rows of the text that id 1 has too
    assert any(k[0] in (five, eight) and k[1] == one for k in out)
