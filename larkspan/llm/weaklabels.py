"""A quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every document. What they
say together is one of at most 3**L patterns; the counts of patterns over all
documents suffice for expectation-maximisation, which estimates how each
labeller votes on good and on bad documents and the posterior of each pattern.
The posterior labels then train a linear scorer on hashed features (byte
trigrams and word shapes), which scores every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import kernel, rows as keyed
from larkspan.session import materialize, ship

U = np.uint64
ABSTAIN, GOOD, BAD = 0, 1, 2
LABELLERS = ("symbols", "repeats", "capitals", "shouting", "length", "word_length", "sentences", "tables", "odd_ends", "variety")
BUCKETS = 1 << 15
#: Documents of each posterior label that the scorer is trained on.
SAMPLE = 1000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]=\\^~_")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[list(b".?!")] = True


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _repeats(texts: kernel.Texts):
    """Words that equal the word before them, and word spans."""
    start, end, first = texts.words()
    h = texts.span_hash(start, end)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    return start, end, first, same


def votes(texts: kernel.Texts, rows: int) -> np.ndarray:
    """The votes of every labeller, (labeller, text)."""
    start, end, first, same = _repeats(texts)
    n = np.diff(first)

    def per_word(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[first])

    letters = texts.per_text(_LETTER[texts.buf])
    size = texts.per_text(~kernel.SEPARATOR[texts.buf])
    symbols = _ratio(texts.per_text(_SYMBOL[texts.buf]), size)
    again = _ratio(per_word(same), n)
    upper = _ratio(texts.per_text(_UPPER[texts.buf]), letters)
    shouts = _ratio(texts.per_text(texts.buf == 33), n)
    mean = _ratio(size, n)
    ends = _ratio(per_word(_END[texts.buf[end - 1]] if len(end) else np.zeros(0, bool)), n)
    bars = _ratio(per_word((end - start == 1) & _SYMBOL[texts.buf[start]] if len(start) else np.zeros(0, bool)), n)
    odd = _ratio(per_word(_SYMBOL[texts.buf[end - 1]] if len(end) else np.zeros(0, bool)), n)
    h = texts.span_hash(start, end)
    doc = kernel.owner(first)
    pair = kernel.mix(kernel.mix(doc[1:].astype(U)) ^ kernel.windows(h, 2)) if len(h) > 1 else np.zeros(0, U)
    inside = doc[1:] == doc[:-1]
    variety = _ratio(np.bincount(doc[1:][inside][np.unique(pair[inside], return_index=True)[1]], minlength=rows), n - 1)

    def vote(good, bad):
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    return np.stack([
        vote(symbols < 0.005, symbols > 0.03), vote(again < 0.02, again > 0.1),
        vote(upper < 0.1, upper > 0.3), vote(shouts < 0.02, shouts > 0.1),
        vote(n >= 30, n < 8), vote((mean >= 3.5) & (mean <= 9), (mean < 2.5) | (mean > 14)),
        vote((ends >= 0.02) & (ends <= 0.3), ends > 0.5), vote(bars < 0.005, bars > 0.1),
        vote(odd < 0.02, odd > 0.15), vote((variety > 0.7) & (n >= 8), (variety < 0.5) & (n >= 8)),
    ])


def patterns(texts: kernel.Texts, rows: int) -> np.ndarray:
    return (votes(texts, rows) * (3 ** np.arange(len(LABELLERS)))[:, None]).sum(axis=0)


def fit_labellers(counts: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over pattern counts: P(vote | good, bad) of each labeller, P(good | pattern) of every pattern, the prior.

    Starts from the share of good votes among the votes cast.
    """
    k = len(LABELLERS)
    codes = np.arange(3**k)
    cast = codes[:, None] // 3 ** np.arange(k) % 3
    n = np.zeros(3**k)
    for c, m in counts.items():
        n[c] = m
    good, bad = (cast == GOOD).sum(1), (cast == BAD).sum(1)
    post = np.where(bad >= 1, 0.1, (good + 1) / (good + bad + 2))
    prior, table = 0.5, np.full((k, 3, 2), 1 / 3)
    for _ in range(rounds):
        mass = np.stack([n * post, n * (1 - post)])
        prior = (mass[0].sum() + 1) / (mass.sum() + 2)
        for j in range(k):
            for v in range(3):
                table[j, v] = mass[:, cast[:, j] == v].sum(1) + 0.1
            table[j] /= table[j].sum(0)
        like = np.log([prior, 1 - prior]) + sum(np.log(table[j])[cast[:, j]] for j in range(k))
        post = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -50, 50)))
    return table, post, prior


def _streams(texts: kernel.Texts):
    """Hashed features: (bucket of each byte trigram, per-text ends), (bucket of each word's shape, per-text ends)."""
    b = texts.buf.astype(np.int64)
    b[kernel.SEPARATOR[texts.buf]] = 32
    tri = np.zeros(len(b), np.int64)
    if len(b) > 2:
        tri[:-2] = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    tri = (kernel.mix(tri.astype(U)) & U(BUCKETS - 1)).astype(np.int64)
    start, end, first, same = _repeats(texts)
    if len(start):
        ends, lead = texts.buf[end - 1], texts.buf[start]
        shape = (
            same * 1 + _END[ends] * 2 + (~_LETTER[ends] & ~_END[ends]) * 4 + _UPPER[lead] * 8
            + ((end - start > 1) & _UPPER[texts.buf[np.minimum(start + 1, end - 1)]]) * 16 + (end - start == 1) * 32 + (end - start > 12) * 64
        )
    else:
        shape = np.zeros(0, np.int64)
    shape = (kernel.mix(shape.astype(U) + U(1 << 40)) & U(BUCKETS - 1)).astype(np.int64)
    return (tri, texts.at), (shape, first)


class Scorer:
    """logit = bias + mean weight of trigrams + mean weight of word shapes."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros((2, BUCKETS)), 0.0

    def logits(self, streams) -> np.ndarray:
        out = self.bias
        for w, (ids, at) in zip(self.weights, streams, strict=True):
            sums = np.concatenate([[0.0], np.cumsum(w[ids])])[at]
            out = out + np.diff(sums) / np.maximum(1, np.diff(at))
        return out

    def fit(self, sparse: list, target: np.ndarray, weight: np.ndarray, epochs: int = 200) -> None:
        """Gradient descent on the weighted logistic loss, with momentum; ``target`` are posteriors, ``sparse`` the streams' shares.

        The step of each block of weights (a stream's, the bias) follows from a bound of the loss's curvature: a quarter of
        the mean squared length of the block's features, for each of the blocks.
        """
        weight = weight / weight.sum()
        speed, drift = np.zeros_like(self.weights), 0.0
        steps = [4 / 3 / max(1e-12, float((weight[doc] * np.square(x, dtype=np.float64)).sum())) for doc, _, x in sparse]
        for _ in range(epochs):
            z = self.bias + sum(np.bincount(doc, w[ids] * x, minlength=len(target)) for w, (doc, ids, x) in zip(self.weights, sparse, strict=True))
            err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
            speed *= 0.9
            for k, (doc, ids, x) in enumerate(sparse):
                speed[k] -= steps[k] * np.bincount(ids, err[doc] * x, minlength=BUCKETS)
            drift = 0.9 * drift - 4 / 3 * err.sum()
            self.weights += speed
            self.bias += drift


def _shares(texts: kernel.Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each stream (document, bucket, share of the document's features) of the buckets that occur."""
    out = []
    for ids, at in _streams(texts):
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key, n = np.unique(doc * BUCKETS + ids, return_counts=True)
        doc, ids = key // BUCKETS, key % BUCKETS
        out.append((doc.astype(np.int32), ids.astype(np.int32), (n / np.maximum(1, np.diff(at))[doc]).astype(np.float32)))
    return out


def _packed(texts: kernel.Texts, rows: int) -> dict:
    """The shares of every text as bytes: at most BUCKETS buckets a stream, however long the text."""
    out = {}
    for k, (doc, ids, x) in enumerate(_shares(texts)):
        at = np.searchsorted(doc, np.arange(rows + 1))
        out[f"ids{k}"] = [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        out[f"x{k}"] = [x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def _unpacked(rows: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for k in range(2):
        ids = [np.frombuffer(r[f"ids{k}"], np.int32) for r in rows]
        doc = np.repeat(np.arange(len(rows)), [len(i) for i in ids])
        none = [np.zeros(0, np.float32)]
        out.append((doc, np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate(none + [np.frombuffer(r[f"x{k}"], np.float32) for r in rows])))
    return out


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(id, pattern, p_weak, score, kept) of every row of ``docs``.

    ``p_weak`` is the label model's posterior that the document is good,
    ``score`` the scorer's probability and ``kept`` whether it reaches
    ``threshold``. No outside labels are used. The label model counts all
    documents; the scorer is trained on at most ``sample`` documents of either
    label, those with the least key, weighted back to the label's share. Their
    features are built in tasks; the driver receives ``BUCKETS`` shares of each
    at most. A null text counts as empty, a very long one is read whole, equal
    texts get equal scores; an empty table gives an empty result; repeated rows
    count as often as they occur; null and repeated ids are carried through;
    other columns are not read, whatever their names.

    Votes are cast twice, to be counted and to be returned with the score:
    a second reading costs less than a shuffle that joins them.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *keyed.key(id_col, text_col))
    id_type = src.schema["_id"].dataType.simpleString()
    seen = materialize(kernel.map_texts(src, ["r1", "r2"], "text", lambda t, n: {"pattern": patterns(t, n)}, "r1 long, r2 long, pattern int"), "votes")
    counts = dict(seen.groupBy("pattern").count().collect())  # at most 3**L rows
    _, post, _ = fit_labellers(counts)
    scorer = Scorer()
    label = {c: post[c] >= 0.5 for c in counts}
    share = {v: sum(m for c, m in counts.items() if label[c] == v) for v in (False, True)}
    chosen: dict = {}
    for v in (False, True):
        of = [c for c in counts if label[c] == v]
        if of:
            picked = seen.where(F.col("pattern").isin(of)).orderBy("r1", "r2").limit(sample).collect()
            chosen |= {(r[0], r[1]): (r[2], share[v] / len(picked)) for r in picked}
    if chosen:
        wanted = spark.createDataFrame(list(chosen), "r1 long, r2 long")  # at most 2 * sample rows
        texts = src.join(F.broadcast(wanted), ["r1", "r2"]).groupBy("r1", "r2").agg(F.first("text").alias("text"))
        shares = kernel.map_texts(texts, ["r1", "r2"], "text", _packed, "r1 long, r2 long, ids0 binary, x0 binary, ids1 binary, x1 binary")
        rows = sorted(shares.collect(), key=lambda r: (r[0], r[1]))
        said = [chosen[r[0], r[1]] for r in rows]
        scorer.fit(_unpacked(rows), np.array([post[p] for p, _ in said]), np.array([w for _, w in said], float))
    ship(spark)
    shared = spark.sparkContext.broadcast((scorer, post))  # BUCKETS weights and 3**L posteriors

    def score(texts, rows):
        s, p = shared.value
        code = patterns(texts, rows)
        z = 1 / (1 + np.exp(-np.clip(s.logits(_streams(texts)), -40, 40)))
        return {"pattern": code, "p_weak": p[code], "score": z, "kept": z >= threshold}

    out = kernel.map_texts(src, ["_id"], "text", score, f"_id {id_type}, pattern int, p_weak double, score double, kept boolean")
    return out.withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: weak posterior and quality score of all ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
