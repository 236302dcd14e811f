"""The verdict of the pipeline's first stage is read from the parse: noise goes, clean short and mixed texts stay."""

import random

import numpy as np
import pytest

import corpus_pipeline
from larkspan.llm import kernel, langid
from larkspan.session import table

LATIN = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def letters(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) if rnd.random() > 0.15 else " " for _ in range(n))


def kept(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in langid.identified(df, model).collect()}


def test_noise_goes(spark, model):
    rnd = random.Random(1)
    texts = [letters(rnd, a, n) for a in (LATIN, "asdfghjkl", LATIN + "äöüß", "αβγδε") for n in (60, 100, 300, 2000, 50_000) for _ in range(10)]
    assert kept(spark, model, texts) == set()


def test_clean_whole_short_and_mixed_texts_stay(spark, docs, model):
    rnd, by = random.Random(2), {}
    for r in docs.collect():
        by.setdefault(r["lang"], []).append(r["text"])
    texts = [t for ts in by.values() for t in ts]
    texts += [" ".join(rnd.choice(by[x]).split()[:n]) for x in by for n in (1, 2, 3, 5, 8, 12) for _ in range(20)]
    texts += [" ".join(" ".join(rnd.choice(by[x]).split()[: rnd.randrange(5, 40)]) for x in rnd.sample(sorted(by), n)) for n in (2, 3, 4) for _ in range(20)]
    with_letters = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    assert kept(spark, model, texts) == with_letters


def test_the_stage_applies_it(spark, docs):
    rnd = random.Random(3)
    junk = spark.createDataFrame([(10**6 + k, letters(rnd, LATIN, 400), "en", "s", 400) for k in range(20)], docs.schema)
    out = corpus_pipeline.language_id(spark, docs.union(junk), "")
    assert out.count() == docs.count() and out.where("doc_id >= 1000000").count() == 0


def test_limits_lie_between_text_and_noise(model):
    rnd = random.Random(4)
    for limit in model.limits:
        assert 0.2 < limit < 0.6
    assert langid.noise([97, 98, 0, 97]) != [] and set(langid.noise([97, 98, 0] * 50)) == {97, 98, 0}
    del rnd


@pytest.mark.parametrize("block", [70, 1000, 4096])
def test_one_long_text_is_parsed_block_by_block_as_a_whole(model, monkeypatch, block):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["the ", "of thand ", "ünde ", "字 ", "!!! ", "ciónado ", "x"]) for _ in range(3000))
    raw = np.frombuffer(text.encode(), np.uint8)
    texts = kernel.Texts(raw, np.array([0, len(raw)]))
    whole = model.predict(texts, 1)
    count = model.phrases(*model.symbols(texts))
    monkeypatch.setattr(langid, "_over", lambda m: block)
    parts = model.predict(texts, 1)
    assert parts["lang_pred"] == whole["lang_pred"] and np.allclose(parts["bits"], whole["bits"]) and np.allclose(parts["score"], whole["score"])
    assert np.isclose(parts["bits"][0], (count[:, 0] * np.array(model.bits)).min() / len(model.symbols(texts)[0]))


def test_long_documents_teach_up_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 1000)
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three"]) for _ in range(n)), x) for i, (n, x) in enumerate([(5000, "a"), (6000, "a"), (40, "b"), (5000, "b"), (50, "b"), (60, "b")] * 3)]
    rows = [(4 * i + 1, t, x) for i, t, x in rows]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~langid.held_out("doc_id"))
    model = langid.fit(df)
    assert model.languages == ["a", "b"] and all(2**b <= 1100 for b in model.bits)
    assert df.where(F.col("lang") == "a").count() > 0
