"""The label model against EM document by document, the scorer against plain sums, its training against the loss."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from larkspan.llm import kernel, weaklabels


def slow_em(votes, rounds=100):
    """Posteriors of documents, each with its list of votes."""
    k = len(weaklabels.LABELLERS)
    post = []
    for v in votes:
        good, bad = v.count(weaklabels.GOOD), v.count(weaklabels.BAD)
        post.append(0.1 if bad else (good + 1) / (good + bad + 2))
    for _ in range(rounds):
        prior = (sum(post) + 1) / (len(post) + 2)
        table = []
        for j in range(k):
            mass = [[0.1, 0.1] for _ in range(3)]
            for v, p in zip(votes, post):
                mass[v[j]][0] += p
                mass[v[j]][1] += 1 - p
            total = [sum(m[c] for m in mass) for c in (0, 1)]
            table.append([[m[c] / total[c] for c in (0, 1)] for m in mass])
        post = []
        for v in votes:
            like = [math.log(q) + sum(math.log(table[j][v[j]][c]) for j in range(k)) for c, q in enumerate((prior, 1 - prior))]
            post.append(1 / (1 + math.exp(min(50, max(-50, like[1] - like[0])))))
    return post, table, prior


def test_em_over_patterns_is_em_over_documents():
    rnd = random.Random(1)
    k = len(weaklabels.LABELLERS)
    votes = []
    for i in range(120):
        good = rnd.random() < 0.7
        votes.append([rnd.choice((0, 1 if good else 2, 1 if good else 2, rnd.choice((0, 1, 2)))) for _ in range(k)])
    codes = [sum(x * 3**j for j, x in enumerate(v)) for v in votes]
    table, post, prior = weaklabels.fit_labellers(dict(Counter(codes)), rounds=20)
    want, slow_table, slow_prior = slow_em(votes, rounds=20)
    assert [post[c] for c in codes] == pytest.approx(want, abs=1e-9)
    assert table == pytest.approx(np.array(slow_table)) and prior == pytest.approx(slow_prior)
    assert len(set(c >= 0.5 for c in want)) == 2


def texts(parts):
    raw = [p.encode() for p in parts]
    return kernel.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def test_logits_are_mean_weights():
    rng = np.random.default_rng(2)
    parts = ["Hello there, hello.", "", "a", "one one one two!", "É unlike the rest " * 20]
    scorer = weaklabels.Scorer()
    scorer.weights, scorer.bias = rng.normal(size=(2, weaklabels.BUCKETS)), 0.25
    got = scorer.logits(weaklabels._streams(texts(parts)))
    packed = weaklabels._packed(texts(parts), len(parts))
    rows = [{c: packed[c][i] for c in packed} for i in range(len(parts))]
    sparse = weaklabels._unpacked(rows)
    for i in range(len(parts)):
        want = 0.25
        for w, (doc, ids, x) in zip(scorer.weights, sparse):
            want += sum(float(w[b]) * float(s) for d, b, s in zip(doc, ids, x) if d == i)
        assert got[i] == pytest.approx(want, abs=1e-5)
        assert all(abs(sum(x[doc == i]) - 1) < 1e-5 for doc, _, x in sparse if (doc == i).any())


def test_training_lowers_the_loss():
    parts = [f"plain words of document number {i} without any signs" for i in range(20)] + [f"##{i} $$ %% {i}## ##" for i in range(20)]
    packed = weaklabels._packed(texts(parts), 40)
    sparse = weaklabels._unpacked([{c: packed[c][i] for c in packed} for i in range(40)])
    target = np.array([0.95] * 20 + [0.05] * 20)
    scorer = weaklabels.Scorer()

    def loss():
        z = scorer.logits(weaklabels._streams(texts(parts)))
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    before = loss()
    scorer.fit(sparse, target, np.ones(40))
    assert loss() < 0.5 * before
