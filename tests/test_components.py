"""Strong components against a plain search, and the number of rounds that long chains take."""

import random

import pytest

from larkspan.operators import graph as gr


def plain(edges):
    """{node: least node of its component} by two depth-first searches, without single nodes that have no loop."""
    out, back = {}, {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
        back.setdefault(t, set()).add(s)
    order, seen = [], set()
    for root in {n for e in edges for n in e}:
        stack = [(root, iter(sorted(out.get(root, ()))))] if root not in seen else []
        seen.add(root)
        while stack:
            n, more = stack[-1]
            for m in more:
                if m not in seen:
                    seen.add(m)
                    stack.append((m, iter(sorted(out.get(m, ())))))
                    break
            else:
                order.append(n)
                stack.pop()
    comp, done = {}, set()
    for root in reversed(order):
        part, stack = [], [root] if root not in done else []
        done.add(root)
        while stack:
            n = stack.pop()
            part.append(n)
            for m in back.get(n, ()):
                if m not in done:
                    done.add(m)
                    stack.append(m)
        if len(part) > 1 or part and (part[0], part[0]) in set(edges):
            comp |= dict.fromkeys(part, min(part))
    return comp


def check(spark, edges):
    rows = gr.strong_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["component"] for r in rows} == plain(edges)


def test_random_graphs_of_many_shapes(spark):
    """Many graphs side by side in one table: sparse ones with chains, cycles that touch, loops, tails and double edges."""
    rnd, edges = random.Random(3), []
    for k in range(60):
        n = rnd.randrange(2, 14)
        base = k * 100
        for _ in range(rnd.randrange(1, 2 * n)):
            edges.append((base + rnd.randrange(n), base + rnd.randrange(n)))
    rnd.shuffle(edges)
    check(spark, edges)


@pytest.mark.parametrize("edges", [
    [(1, 2), (2, 3), (3, 1)], [(1, 1)], [(1, 2), (2, 1), (1, 1)], [(5, 6), (6, 7)], [(9, 8), (8, 9), (9, 7), (7, 9)],
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)],  # two cycles with a chain between
    [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1), (5, 6)],  # two chains that come back to one node
])
def test_small_shapes(spark, edges):
    check(spark, edges)


def rounds(monkeypatch):
    """Counts the tables that are written."""
    n, real = [0], gr.materialize

    def counted(df, name="t"):
        n[0] += name in ("jumps", "colours", "back", "trim")
        return real(df, name)

    monkeypatch.setattr(gr, "materialize", counted)
    return n


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    n, size = rounds(monkeypatch), 10_000
    names = list(range(size))
    random.Random(1).shuffle(names)
    edges = list(zip(names, names[1:] + names[:1], strict=True))
    out = gr.strong_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert out.count() == size and {r["component"] for r in out.collect()} == {0} and n[0] < 40


def test_long_chains_that_are_not_closed_go_in_few_rounds(spark, monkeypatch):
    """A chain into a small cycle, one out of it and one beside it."""
    n, size = rounds(monkeypatch), 3000
    edges = [(i, i + 1) for i in range(size)] + [(size, size + 1), (size + 1, size)] + [(size + 1 + i, size + 2 + i) for i in range(1, size)] + [(size, size + 2)]
    edges += [(10**6 + i, 10**6 + i + 1) for i in range(size)]
    out = gr.strong_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in out} == {size: size, size + 1: size} and n[0] < 40


def test_the_graph_of_all_lines(spark, data):
    from larkspan.plans import graph_queries

    want = plain([tuple(r) for r in graph_queries._edges(spark, data, 0).select("s", "t").collect()])
    assert {r["node"]: r["component"] for r in graph_queries.scc_all_lines(spark, data).collect()} == want and want


def test_closing_chains_of_many_edges_with_ties(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(25):02}", f"n{rnd.randrange(25):02}") for _ in range(45)] + [("x", "x")]
    added = [(f"n{rnd.randrange(25):02}", f"n{rnd.randrange(25):02}") for _ in range(40)] + [("n01", "gone"), ("x", "x")]
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)

    def chain(a, b):
        if a == b:
            return None
        front, seen = {b: [b]}, {b}
        for _ in range(6):
            new: dict = {}
            for n, p in front.items():
                for m in out.get(n, ()):
                    if m not in seen:
                        new[m] = min(new.get(m, [*p, m]), [*p, m])
            if a in new:
                return new[a]
            seen |= set(new)
            front = new
        return None

    want = {(a, b): chain(a, b) for a, b in added if chain(a, b)}
    got = gr.closing_chains(spark.createDataFrame(edges, "f string, g string"), spark.createDataFrame(added, "f string, g string"), "f", "g", 6)
    assert {(r["f"], r["g"]): r["chain"] for r in got.collect()} == want and max(map(len, want.values())) > 3
