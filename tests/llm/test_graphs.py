"""Components by stars: right on graphs of many shapes, and no more rounds than it takes to get to stars."""

import random

import pytest
from larkspan.llm import graphs


def brute(edges):
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


def run(spark, monkeypatch, edges):
    writes, write = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, name="t": writes.append(name) or write(df, name))
    found = graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()
    monkeypatch.undo()
    assert len(found) == len({r[0] for r in found})
    assert {r["node"]: r["component"] for r in found} == brute(edges)
    return len(writes)


@pytest.mark.parametrize(("edges", "writes"), [
    ([], 1),
    ([(4, 4)], 1),
    ([(1, 2), (3, 1), (2, 1), (1, 9), (5, 6), (7, 5), (7, 7)], 1),  # stars already: nothing to do, nothing to confirm
    ([(9, k) for k in range(9)], 2),
    ([(1, 3), (2, 3)], 2),
])
def test_rounds_end_when_only_stars_are_left(spark, monkeypatch, edges, writes):
    assert run(spark, monkeypatch, edges) == writes


def test_chains_cycles_and_random_graphs(spark, monkeypatch):
    rnd = random.Random(7)
    chain = [(k, k + 1) for k in range(30)] + [(100 + k, 100 + (k + 1) % 11) for k in range(11)]
    rnd.shuffle(chain)
    some = [(1000 + rnd.randrange(120), 1000 + rnd.randrange(120)) for _ in range(90)]
    run(spark, monkeypatch, chain + some + some[:20])
