"""Operators on small frames with answers worked out by hand or by a plain version."""

import io
import json
import os
import random
import sqlite3
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as tx, urls, vectors as vx
from larkspan.operators import code, duplicates as du, graph as gr, history as hi, notes, retrieval as rt, rules as ru, snapshots as sn, telemetry as tm, web, windows as wi
from larkspan.session import materialize
from larkspan.sources import corpus, documents as ds
from larkspan.streaming import events as st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, column, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(column).first()[0]


def test_bm25_equals_fts5(spark):
    words = ["alpha", "beta", "gamma", "delta", "snake", "case", "über", "plan"]
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 2))), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(path, text)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("insert into f(rowid, path, text) values (?, ?, ?)", docs)
    terms = ["alpha", "snake_case", "uber", "nowhere"]
    want = {r[0]: -r[1] for r in db.execute("select rowid, bm25(f, 3.0, 1.0) from f where f match ?", (" OR ".join(f'"{t}"' for t in terms),))}
    q = spark.createDataFrame([(1, terms)], "query_id int, terms array<string>")
    got = {r["doc_id"]: r["score"] for r in rt.bm25(q, spark.createDataFrame(docs, "doc_id int, path string, text string"), {"path": 3.0, "text": 1.0}).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_terms(spark):
    t = value(spark, tx.query_terms(F.col("q")), q="Foo foo_bar a é café Foo")
    assert t == ["Foo", "foo_bar", "café"]
    assert value(spark, tx.query_terms(F.col("q")), q="! ?") == []


def test_fusion(spark):
    s = "g int, k int, score double"
    v, x = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5)], s), spark.createDataFrame([(1, 2, 7.0), (1, 3, 3.0)], s)
    assert rows(rt.fuse(v, x, ["g"], "k")) == [(1, 1, 0.75), (1, 2, 0.25), (1, 3, 0.0)]
    none = spark.createDataFrame([], s)
    assert rows(rt.fuse(v, none, ["g"], "k")) == [(1, 1, 0.9), (1, 2, 0.5)]
    assert rows(rt.fuse(none, x, ["g"], "k")) == [(1, 2, 1.0), (1, 3, 0.0)]
    same = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.4)], s)
    assert rows(rt.fuse(same, x, ["g"], "k"))[0] == (1, 1, 0.75)


def test_vectors(spark):
    assert value(spark, vx.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert value(spark, vx.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert not value(spark, vx.valid(F.col("a")), a=[1.0, float("nan")])
    assert not value(spark, vx.valid(F.col("a"), 3), a=[1.0])
    with pytest.raises(Exception, match="different dimensions"):
        value(spark, vx.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0])


def test_limits():
    assert rt.proportional_limits({"code": 5, "doc": 5}) == {"code": 5, "doc": 5}
    out = rt.proportional_limits({"code": 20, "doc": 20, "test": 1})
    assert sum(out.values()) <= 20 and out["test"] == 1


def test_jaccard_equals_plain_version(spark):
    rnd = random.Random(2)
    base = [[rnd.choice("abcdefghijklmnop") for _ in range(40)] for _ in range(12)]
    docs = [(i, " ".join(t if rnd.random() > 0.02 else "z" for t in base[i % 12])) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(36)} for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    s = du.shingle_rows(spark.createDataFrame(docs, "id int, t string"), "id", F.split("t", " "))
    assert {(r["a"], r["b"]) for r in du.jaccard_pairs(s, "id").collect()} == want and want


def test_cosine_pairs_blocks(spark):
    rnd = random.Random(3)
    v = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(50, [0.0] * 4)]
    df = spark.createDataFrame(v, "id int, v array<double>")
    a = {(r[0], r[1]) for r in du.cosine_pairs(df, "id", "v", 0.7, block=7).collect()}

    def cos(x, y):
        n = sum(p * p for p in x) ** 0.5 * sum(p * p for p in y) ** 0.5
        return sum(p * q for p, q in zip(x, y)) / n if n else 0

    assert a == {(i, j) for i, x in v for j, y in v if i < j and cos(x, y) >= 0.7}


def tarjan(edges):
    graph = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, [])
    index, low, stack, on, out = {}, {}, [], set(), []

    def go(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for w in graph[v]:
            if w not in index:
                go(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while True:
                w = stack.pop()
                on.discard(w)
                part.append(w)
                if w == v:
                    break
            if len(part) > 1 or v in graph[v]:
                out.append(part)

    for v in list(graph):
        if v not in index:
            go(v)
    return {x: min(p) for p in out for x in p}


def test_strong_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(1, 30), rnd.randint(1, 30)) for _ in range(45)] + [(40, 40), (41, 42), (42, 41)]
    got = dict(rows(gr.strong_components(spark.createDataFrame(edges, "s int, t int"), "s", "t")))
    assert got == tarjan(edges)


def test_bfs_on_a_cycle_and_stops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "s int, t int")
    assert rows(gr.bfs(e, spark.createDataFrame([(1,)], "n int"), "s", "t")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(gr.bfs(e, spark.createDataFrame([(1,)], "n int"), "s", "t", stop_at=spark.createDataFrame([(3,)], "n int"))) == [(1, 0), (2, 1), (3, 2)]
    assert gr.closing_chain(e, "s", "t", 1, 5) == [1, 2, 3, 4, 5]
    assert gr.closing_chain(e, "s", "t", 5, 1) == []


def test_interval_join(spark):
    rnd = random.Random(5)
    a = [(1, s, s + rnd.randint(0, 300)) for s in (rnd.randint(0, 1000) for _ in range(40))]
    b = [(1, s, s + rnd.randint(0, 300)) for s in (rnd.randint(0, 1000) for _ in range(40))]
    got = Counter(tuple(r) for r in gr.interval_join(spark.createDataFrame(a, "p int, s int, e int"), spark.createDataFrame(b, "p int, cs int, ce int"), "p", ("s", "e"), ("cs", "ce")).select("s", "e", "cs", "ce").collect())
    assert got == Counter((s, e, x, y) for _, s, e in a for _, x, y in b if x <= e and y >= s)


def test_interval_join_of_any_length(spark):
    """Long and short, negative, reversed and null ends against all pairs; a long interval gives as few rows as a short one."""
    rnd = random.Random(6)

    def some(n):
        rows = [(rnd.randint(0, 2), s, s + rnd.choice([0, 1, 15, 16, 17, 1000, 10**7, -5])) for s in (rnd.randint(-(10**4), 10**7) for _ in range(n))]
        return rows + rows[:3] + [(1, None, 5), (None, 1, 5), (1, 7, None)]

    a, b = some(120), some(120)
    left, right = spark.createDataFrame(a, "p int, s int, e int"), spark.createDataFrame(b, "p int, cs long, ce long")
    joined = gr.interval_join(left, right, "p", ("s", "e"), ("cs", "ce"))
    assert sorted(joined.columns) == ["ce", "cs", "e", "p", "s"]
    got = Counter(tuple(r) for r in joined.select("p", "s", "e", "cs", "ce").collect())
    ok = lambda r: None not in r
    assert got == Counter((p, s, e, x, y) for p, s, e in filter(ok, a) for q, x, y in filter(ok, b) if p == q and x <= e and y >= s)
    assert gr.interval_join(left.limit(0), right, "p", ("s", "e"), ("cs", "ce")).count() == 0


def test_files_that_ask_for_all_tests(spark):
    build = [
        "pnpm-lock.yaml", "pnpm-workspace.yaml", "web/bun.lockb", "poetry.lock", "uv.lock", "Pipfile", "Pipfile.lock", "jest.config.ts", "a/vite.config.js", "vitest.config.mts",
        "babel.config.json", ".babelrc", ".mocharc.yml", ".env", ".env.local", "settings.gradle.kts", "gradle.properties", "go.work.sum", "jsconfig.json", "npm-shrinkwrap.json",
        "dev-requirements.txt", "tsconfig.build.json", "package.json", "setup.cfg"]
    other = [".github/workflows/package.json", "sub/.github/x.py", "Jenkinsfile", "LICENSE.md", "CODEOWNERS", "my.env", "package.json.bak", "jest.config", "go.mod.txt", "xgo.mod", "requirements/base.txt"]
    changes = spark.createDataFrame([(p,) for p in build + other + ["src/new.py", "src/old.py"]], "path string")
    kind = F.when(F.col("path").endswith(".py") | (F.col("path") == "Jenkinsfile"), "code").otherwise("other")
    got = dict(rows(gr.run_all_reasons(changes, spark.createDataFrame([("src/old.py",)], "path string"), kind)))
    assert got == {"src/new.py": "not analysed"} | {p: "configuration" for p in build}


def test_keyword_overlap_finds_parts_of_words(spark):
    """Every term in every text, by plain containment: parts of words, one letter, white space, case, ties, nulls, empty terms."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcÄ. ") for _ in range(rnd.randint(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 6)))) for i in range(80)] + [(80, None), (81, ""), (82, "abc\tabc b"), (83, "abc abc b")]
    queries = [(q, [word() for _ in range(rnd.randint(0, 5))]) for q in range(20)] + [(20, ["", "abc abc", "a", "A", "zzz", " "]), (21, None), (22, ["abc", "abc"])]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, terms array<string>")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in rt.keyword_overlap(q, d, F.col("text")).collect()}
    want = {(k, i): sum(t.strip() != "" and t.lower() in x.lower() for t in ts) for k, ts in queries if ts for i, x in docs if x}
    assert got == {k: n for k, n in want.items() if n}
    assert rt.keyword_overlap(q.limit(0), d, F.col("text")).count() == 0
    assert rt.keyword_overlap(q, d.limit(0), F.col("text")).count() == 0


def test_entry_points_follow_few_roots(spark, monkeypatch):
    """The first roots by reach against all sets of nodes reached; sketches leave most roots unfollowed."""
    rnd = random.Random(8)
    edges = {(-r, rnd.randint(1, 400)) for r in range(1, 301) for _ in range(rnd.choice([1, 2, 3, 30]))} | {(n, rnd.randint(1, 400)) for n in range(1, 401) if n % 3} | {(7, 7)}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {a for a, _ in edges}:
        seen = front = {n}
        for _ in range(3):
            front = set().union(*(out.get(x, set()) for x in front)) - seen
            seen = seen | front
        reach[n] = len(seen) - 1
    roots = sorted((n for n in reach if n < 0 and n != -5 and reach[n] >= 3), key=lambda n: (-reach[n], n))[:10]
    followed = []
    plain = gr.reach_counts
    monkeypatch.setattr(gr, "reach_counts", lambda e, s, t, d, seeds: followed.append(seeds.count()) or plain(e, s, t, d, seeds))
    e = spark.createDataFrame(sorted(edges), "s long, t long")
    nodes = spark.createDataFrame([(n,) for n in [*range(-300, 0), *range(1, 401)]], "node long")
    got = {tuple(r) for r in gr.entry_points(e, nodes, "node", "s", "t", F.col("node").isin(-5, 3), most=10, depth=3).collect()}
    assert got == {(n, reach[n], "root") for n in roots} | {(n, reach.get(n, 0), "declared") for n in (-5, 3)}
    assert followed[0] < 150
    assert gr.entry_points(e.limit(0), nodes, "node", "s", "t", F.lit(False), most=10, depth=3).count() == 0


def test_affected_tests(spark):
    symbols = spark.createDataFrame([("a", "m.py", 1, 20), ("b", "m.py", 5, 9), ("t", "test_m.py", 1, 5), ("u", "test_u.py", 1, 5)], "id string, path string, start_line int, end_line int")
    calls = spark.createDataFrame([("t", "b"), ("u", "a")], "source string, target string")
    imports = spark.createDataFrame([("test_u.py", "m.py")], "source string, target string")
    changes = spark.createDataFrame([("m.py", 6)], "path string, line int")
    assert rows(gr.affected_tests(symbols, calls, imports, changes, F.col("path").startswith("test"))) == [("test_m.py", "calls", 1), ("test_u.py", "imports", 1)]


def test_rename_chain_and_partners(spark):
    assert rows(hi.rename_chain(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string"), "old", "new")) == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")]
    pairs = spark.createDataFrame([(1, 2, 5, 0.5), (1, 3, 5, 0.4), (2, 3, 6, 0.6)], "a int, b int, shared int, degree double")
    assert [(r["changed"], r["partner"]) for r in hi.partners(pairs, spark.createDataFrame([(1,), (2,)], "f int"), "f").collect()] == [(2, 3)]


def test_rename_needs_a_unique_digest(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h2")], "p string, h string")
    new = spark.createDataFrame([("x", "h1"), ("y", "h2")], "p string, h string")
    assert rows(sn.renames(old, new, "p", "h")) == [("a", "x")]


def test_publish_swaps_generations(spark, tmp_path):
    where = str(tmp_path / "t")
    assert sn.publish(spark.range(3).toDF("x"), where)
    assert not sn.publish(spark.range(9).toDF("x"), where, failures=1)
    assert spark.read.parquet(where).count() == 3
    assert sn.publish(spark.range(5).toDF("x"), where)
    assert spark.read.parquet(where).count() == 5
    assert os.listdir(tmp_path) == ["t"]


def test_dynamic_partitions_and_chunks(spark, tmp_path):
    where = str(tmp_path / "p")
    sn.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), where, ["k"])
    sn.write_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), where, ["k"])
    assert rows(spark.read.parquet(where).select("v", "k")) == [(1, "a"), (9, "b")]


def test_chunks():
    text = "\n".join(f"def f{k}():\n    pass" for k in range(200))
    got = list(corpus.chunk_lines(text))
    lines = text.split("\n")
    assert got[0][0] == 1 and got[-1][1] == len(lines)
    assert all(t == "\n".join(lines[a - 1 : b]) and b - a < 200 and len(t) <= 8000 for a, b, t in got)
    assert all(x[1] >= y[0] - 1 and x[1] - y[0] < 12 for x, y in zip(got, got[1:]))
    assert [len(t) for _, _, t in corpus.chunk_lines("x" * 20_000)] == [8000, 8000, 4000]
    assert list(corpus.chunk_lines("")) == [(1, 1, "")]
    assert "".join(corpus.split_text("ab\n" * 2000)) == "ab\n" * 2000
    assert corpus.group_parts(["a" * 4000, "b" * 4000, "c"]) == [["a" * 4000], ["b" * 4000, "c"]]
    assert corpus.take_within([5, 9, 3, 2], 10) == [0, 2, 3]


def test_scope(spark, tmp_path):
    for p in ("src/a.py", "src/b.log", "src/.hid/c.py", "docs/x.md", "build/y.js", "top.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = rows(corpus.walk(spark, str(tmp_path), ["src", "docs"], [], ru.ignore_rules(["*.log"])).select("path"))
    assert got == [("docs/x.md",), ("src/a.py",), ("top.txt",)]


def test_ignore_rules(spark):
    rules = ru.ignore_rules(["*.log", "!keep.log", "/out/", "tmp"]) + ru.ignore_rules(["!deep.log"], "a")
    for path, want in (("x.log", True), ("keep.log", False), ("out/a", True), ("b/out/a", False), ("b/tmp/c", True), ("a/deep.log", False), ("b/deep.log", True)):
        assert value(spark, ru.ignored(F.col("p"), rules), p=path) == want, path


def test_skip_reasons(spark):
    cases = {"a.py": b"x = 1\n", ".env": b"x", "k.pem": b"x", "e.txt": b"", "b.bin": b"a\0b", "m.js": b"x" * 9000, "s.txt": b"-----BEGIN RSA PRIVATE KEY-----\n", "l.js": b"\n".join([b"y" * 5000] * 3), "big.txt": b"a\n" * 600_000}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in cases.items()], "p string, c binary")
    got = {r[0]: r[1] for r in df.select("p", corpus.skip_reason(F.col("p"), F.col("c"))).collect()}
    assert got == {"a.py": None, ".env": "dotfile", "k.pem": "secret_name", "e.txt": "empty", "b.bin": "binary", "m.js": "minified", "s.txt": "secret_header", "l.js": "minified", "big.txt": "too_large"}


def test_decode():
    assert corpus.decode_bytes("é".encode("utf-16")) == ("é", "utf-16")
    assert corpus.decode_bytes(b"\xef\xbb\xbfa") == ("a", "utf-8")
    assert corpus.decode_bytes("é".encode("latin-1"), "latin-1") == ("é", "latin-1")
    assert corpus.decode_bytes(b"\xff\xfea\xd8")[0] is None and corpus.decode_bytes(b"\xe9") == (None, "refused")


def test_git_records():
    assert corpus.parse_status("R  new\0old\0 M x\0?? y\0") == [("R", "new"), ("M", "x"), ("??", "y")]
    raw = "\x1eb\x1f20\x1fsecond\x1f\x1fR100\ta\tb\nM\tc\x1ea\x1f10\x1ffirst\x1fwhy\x1fA\ta"
    got = corpus.parse_history(raw)
    assert [c["files"] for c in got] == [["b", "c"], ["b"]] and got[1]["body"] == "why"


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts": 1.0, "event": "x"}\nnot json\n{"ts": 5.0, "event": "y"}\n')
    (tmp_path / "a.jsonl.1").write_text('{"ts": 3.0, "event": "z"}\n')
    got = corpus.read_log(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "a.jsonl.1")], "ts double, event string", since=2.0)
    assert rows(got) == [(3.0, "z"), (5.0, "y")]


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


def test_documents(spark):
    docx = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    pptx = zipped({"ppt/slides/slide2.xml": '<s xmlns:a="a"><a:p><a:t>two</a:t></a:p></s>', "ppt/slides/slide1.xml": '<s xmlns:a="a"><a:p><a:t>one</a:t></a:p></s>', "ppt/notesSlides/notesSlide1.xml": '<s xmlns:a="a"><a:p><a:t>say</a:t></a:p></s>'})
    xlsx = zipped({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<t><si><t>hi</t></si></t>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'})
    epub = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/c.opf"/></c>', "o/c.opf": '<p><item id="a" href="a.html"/><item id="b" href="b.html"/><itemref idref="b"/><itemref idref="a"/></p>', "o/a.html": "<p>A</p>", "o/b.html": "<p>B</p>"})
    html = b"<html><head><title>T</title><style>x</style></head><body><h2>H</h2><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><p>p &amp; q<script>no</script></body></html>"
    files = {"d.docx": docx, "p.pptx": pptx, "x.xlsx": xlsx, "e.epub": epub, "h.html": html, "c.csv": b"a;b\n\n1;2\n", "t.txt": "é".encode(), "bad.docx": b"no", "f.pdf": b"%PDF"}
    got = {}
    for r in ds.extract(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).collect():
        got.setdefault(r["path"], []).append((r["name"], r["text"]) if r["reason"] is None else None)
    assert got["d.docx"] == [("part", "# Top\nBody\na | b")]
    assert got["p.pptx"] == [("slide 1", "one\nNotes: say"), ("slide 2", "two")]
    assert got["x.xlsx"] == [("S", "hi\t7")]
    assert got["e.epub"] == [("b.html", "B"), ("a.html", "A")]
    assert got["h.html"] == [("part", "# T\n## H\n- one\n- two\na | b\np & q")]
    assert got["c.csv"] == [("part", "a\tb\n1\t2")]
    assert got["t.txt"] == [("text", "é")] and got["bad.docx"] == [None]


def test_ranges():
    assert ds.parse_ranges("3, 5-7, 9-, -2, S", 10, ["S"]) == [3, 5, 6, 7, 9, 10, 1, 2]
    for bad in ("0", "x", "-", "99"):
        with pytest.raises(ValueError):
            ds.parse_ranges(bad, 10)


def test_manifests():
    assert ds.dependencies("a/package.json", json.dumps({"dependencies": {"x": "^1"}})) == [("npm", "x", "^1")]
    assert ds.dependencies("requirements-dev.txt", "# c\nDjango[x]>=4 ; python\n-r y\n") == [("pypi", "django", ">=4")]
    assert ds.dependencies("go.mod", "require (\n\tgithub.com/a/b v1.2.3\n)") == [("go", "github.com/a/b", "v1.2.3")]
    assert ds.dependencies("pyproject.toml", '[project]\ndependencies = ["a>=1"]') == [("pypi", "a", ">=1")]
    assert ds.dependencies("Cargo.toml", '[dependencies]\na = "1"\nb = {version = "2"}') == [("cargo", "a", "1"), ("cargo", "b", "2")]
    assert ds.dependencies("pom.xml", "<p><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></p>") == [("maven", "g:a", "1")]
    assert ds.dependencies("x.txt", "a") == []


def test_versions(spark):
    for spec, v, want in (("^1.2", "1.9.0", True), ("^1.2", "2.0", False), ("~1.2.3", "1.2.9", True), ("~1.2.3", "1.3.0", False), (">=1.10", "1.9", False), ("1.2", "1.2.5", True), ("*", "9", True)):
        assert value(spark, code.satisfies(F.col("s"), F.col("v")), s=spec, v=v) == want, (spec, v)


def test_python_facts_and_resolution(spark):
    files = spark.createDataFrame([
        ("pkg/a.py", "from pkg.b import helper\nimport os\n\ndef run():\n    helper()\n    local()\n    os.getcwd()\n\ndef local():\n    pass\n"),
        ("pkg/b.py", "class C:\n    def m(self):\n        self.n()\n    def n(self):\n        pass\n\ndef helper():\n    C()\n"), ("bad.py", "def ("),
    ], "path string, text string")
    ok, bad = code.resolve_calls(materialize(code.facts(files), "facts"))
    assert {(r["source"], r["target"]) for r in ok.collect()} == {("pkg/a.py::run", "pkg/b.py::helper"), ("pkg/a.py::run", "pkg/a.py::local"), ("pkg/b.py::C.m", "pkg/b.py::C.n"), ("pkg/b.py::helper", "pkg/b.py::C")}
    assert [(r["expression"], r["reason"]) for r in bad.collect()] == [("os.getcwd", "unknown name")]


def test_references(spark):
    assert code.references("[a](x.md) `[b](y.md)`\n```\n[c](z.md)\n```\n<img src='i.png'>") == [("x.md", 1, "markdown"), ("i.png", 5, "markup")]
    files = spark.createDataFrame([("d/a.md", "[x](b.md#h) [y](https://e) [z](../gone.md)"), ("d/b.md", "")], "path string, text string")
    assert {(r["target"], r["resolution"]) for r in code.reference_edges(files).collect()} == {("b.md#h", "resolved"), ("https://e", "external"), ("../gone.md", "unresolved")}


def test_code_tokens(spark):
    assert du.abstract_tokens("def f(x):\n    return g(x.y, 'a', 3)\n") == ["def", "f", "(", "ID", ")", ":", "return", "g", "(", "ID", ".", "y", ",", "STR", ",", "NUM", ")"]
    df = spark.createDataFrame([("x = 1  # c",), ("x   =  1",)], "t string")
    a, b = (r[0] for r in df.select(du.code_body("t")).collect())
    assert a == b


def test_diff():
    assert code.touched_lines("a\nb\nc", "a\nB\nc\nd") == [2, 4]
    assert code.unified_diff("a", "b").split("\n")[-2:] == ["-a", "+b"]


def test_fixtures_and_nearest_file(spark):
    f = spark.createDataFrame([("tests", ["db"])], "folder string, names array<string>")
    t = spark.createDataFrame([("t1", "tests/a.py", ["db", "x"]), ("t2", "other/b.py", ["db"])], "test string, path string, parameters array<string>")
    assert rows(code.fixture_users(f, t)) == [("tests", "t1")]
    m = spark.createDataFrame([("a/b/c.py", "d.json")], "path string, literal string")
    assert rows(code.nearest_file(m, spark.createDataFrame([("d.json",), ("a/d.json",)], "path string"))) == [("a/b/c.py", "d.json", "a/d.json")]


def test_round_robin_loses_the_turn(spark):
    r = spark.createDataFrame([("a", 1, "u"), ("a", 2, "v"), ("b", 1, "u"), ("b", 2, "w"), ("b", 3, ""), ("a", 3, "")], "tier string, rank int, url string").withColumn("q", F.lit(1))
    out = wi.interleave(r, ["q"], F.col("tier"), "rank", F.col("tier"), "url")
    assert [x["url"] for x in out.orderBy("place").collect()] == ["u", "v", "w", "", ""]


def test_urls(spark):
    assert value(spark, urls.on_sites(F.col("u"), ["ex.org"]), u="https://a.ex.org/x")
    assert not value(spark, urls.on_sites(F.col("u"), ["ex.org"]), u="https://notex.org/x")
    assert not value(spark, urls.on_sites(F.col("u"), ["ex.org"]), u="::not a url")
    assert value(spark, urls.normalise(F.col("u")), u="https://a/x#y") == "https://a/x"


def test_thin(spark):
    for t, want in (("x" * 100, True), ("x" * 2000, False), ("Loading... " + "x" * 2000, True), ("Loading... " + "x" * 6000, False)):
        assert value(spark, web.thin(F.col("t")), t=t) == want


def test_failure_classes(spark):
    for e, want in (("CircuitOpen: 503", "circuit_open"), ("HTTP 429 timed out", "429"), ("HTTP Error 403", "auth"), ("HTTP 502", "5xx"), ("HTTP 404", "other"), ("read timed out", "timeout"), ("Connection refused", "connection"), (None, "other")):
        assert value(spark, tm.failure_class(F.col("e").cast("string")), e=e) == want, e


def test_next_event_bound_is_inclusive(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:15:00"), (1, 3, "2024-01-01 00:30:00.001"), (2, 4, "2024-01-01 00:00:00")], "s int, id int, t string").withColumn("t", F.to_timestamp("t"))
    assert {r["id"]: r["next_id"] for r in tm.next_event(df, "s", "t", "id", carry=("id",)).collect()} == {1: 2, 2: None, 3: None, 4: None}


def test_note_windows_and_orders(spark):
    w = spark.createDataFrame([(1, 1, 3, 5), (1, 2, 4, 9), (1, 6, 8, 4), (1, 10, 11, 1)], "f int, start int, end int, score int")
    assert rows(notes.evidence_windows(w, ["f"], "start", "end", "score")) == [(1, 1, 2, 4, 9), (1, 2, 6, 8, 4)]
    assert rows(notes.drop_overlaps(w, ["f"], "score", "start", "end").select("start")) == [(1,), (6,), (10,)]


def test_comments(spark):
    for text, want in (("x = f(a);\nfoo(1);", "commented_code"), ("see JIRA-12", "history_tag"), ("plain words", None)):
        assert value(spark, ru.comment_finding(F.col("t"), F.lit(False), F.lit(False), F.lit(1)), t=text) == want


def test_credentials_never_return_the_value(spark):
    secret = "ghp_" + "a" * 36
    df = spark.createDataFrame([(1, f"x\nkey {secret}\nexample {secret}")], "id int, t string")
    out = ru.credentials(df, "id", "t")
    assert rows(out) == [("github", 1, 2)] and secret not in str(out.collect())


def test_gap_levels():
    assert st.next_gap(0, None, 0) == (0, True)
    assert st.next_gap(0, 0, 30) == (0, False)
    assert st.next_gap(0, 0, 60) == (1, True)
    assert st.next_gap(1, 0, 240) == (0, True)


def test_streams_equal_batches(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = st.parquet_stream(spark, f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sent = rows(st.run_available(st.once_a_day(s.where("event_type = 'error'"), "user_id", "ts", "event_id"), "append", "t"))
    want, last = [], {}
    for r in e.where("event_type = 'error'").orderBy("ts", "event_id").collect():
        at = r["ts"].timestamp()
        if r["user_id"] not in last or at - last[r["user_id"]] >= 86_400:
            last[r["user_id"]] = at
            want.append((r["user_id"], r["event_id"]))
    assert sent == sorted(want)


def test_lease_settles(spark):
    q = spark.createDataFrame([(1, "leased"), (2, "leased"), (3, "done")], "id int, status string")
    assert rows(st.settle(q, spark.createDataFrame([(1, True), (2, False), (3, False)], "id int, ok boolean")).select("id", "status")) == [(1, "done"), (2, "pending"), (3, "done")]


def test_layers_first_match(spark):
    items = spark.createDataFrame([("ui/a",), ("core/b",), ("x",)], "p string")
    rules = spark.createDataFrame([(1, "core", "^core/"), (0, "ui", "^ui/|^core/u")], "ordinal int, layer string, pattern string")
    assert rows(gr.assign_layer(items, rules, "p", F.expr("p RLIKE pattern"))) == [("core/b", "core", 1), ("ui/a", "ui", 0), ("x", None, None)]
