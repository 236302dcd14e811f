"""The data sources over small repositories made here, and over providers that answer, fail and dawdle."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from larkspan.sources import repositories as rp
from larkspan.sources.corpus import parse_history

PROVIDERS = '''
import time
from pathlib import Path
def good(query):
    for i in range(5):
        yield {"title": f"{query} {i}", "url": f"http://x/{query}/{i}", "snippet": "s"}
def broken(query):
    yield {"title": "one", "url": "http://y/1"}
    raise ValueError("no more")
def slow(query):
    time.sleep(0.4)
    yield {"title": query, "url": "http://z"}
def none(query):
    return []
'''


def run(repo, *args):
    env = {**os.environ, "GIT_AUTHOR_DATE": run.date, "GIT_COMMITTER_DATE": run.date, "GIT_CONFIG_GLOBAL": "/dev/null"}
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, env=env)


def make(repo, n=12):
    repo.mkdir()
    run.date = "2024-01-01T00:00:00Z"
    run(repo, "init", "-q", "-b", "main")
    (repo / "src").mkdir()
    (repo / "src" / "old.py").write_text("def f():\n    return 1\n" * 5)
    for i in range(n):
        run.date = f"2024-01-{i + 2:02}T00:00:00Z"
        (repo / "src" / "a b.py").write_text(f"x = {i}\n")
        (repo / f"doc{i % 3}.md").write_text(f"# {i} ü\n")
        if i == 4:
            run(repo, "mv", "src/old.py", "src/mid.py")
        if i == 8:
            run(repo, "mv", "src/mid.py", "src/new.py")
        if i == 9:
            (repo / "bin.dat").write_bytes(b"a\0b")
            (repo / "latin.txt").write_bytes("é".encode("latin-1"))
            (repo / "big.txt").write_text("y" * 5000)
            (repo / "link.py").symlink_to("src/new.py")
        run(repo, "add", "-A")
        run(repo, "commit", "-q", "-m", f"change {i}", "-m", f"body {i}\nsecond line")
    run(repo, "checkout", "-q", "-b", "side")
    (repo / "side.txt").write_text("s")
    run(repo, "add", "-A")
    run(repo, "commit", "-q", "-m", "on a side")
    run(repo, "checkout", "-q", "main")
    run(repo, "merge", "-q", "--no-ff", "-m", "a merge", "side")
    return str(repo)


@pytest.fixture(scope="module")
def repos(spark, tmp_path_factory):
    rp.register(spark)
    top = tmp_path_factory.mktemp("repos")
    return [make(top / "one"), make(top / "two", 3)]


def load(spark, name, path, **options):
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load(path)


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_history_in_slices_equals_the_parser_on_the_whole(spark, repos, size):
    raw = rp.git(repos[0], "log", "--no-merges", "-M", "--name-status", rp._FIELDS, "HEAD")
    want = [(i, c["hash"], c["time"], c["subject"], c["body"], c["files"]) for i, c in enumerate(parse_history(raw))]
    df = load(spark, "larkspan-history", repos[0], slice=size)
    got = sorted((r["nth"], r["hash"], r["time"], r["subject"], r["body"], r["files"]) for r in df.collect())
    assert got == want and len(got) == 13 and df.rdd.getNumPartitions() == -(-13 // size)
    assert not any("merge" in r[3] for r in got)
    # the file has today's name in the oldest commit, two renames away
    assert "src/new.py" in got[-1][5] and "src/old.py" not in got[-1][5]
    assert load(spark, "larkspan-history", repos[0], maxCommits=4).count() == 4


def test_tracked_files_are_guarded(spark, repos):
    got = {r["path"]: (r["text"], r["skipped"]) for r in load(spark, "larkspan-files", repos[0], maxBytes=4000).collect()}
    assert got["src/a b.py"] == ("x = 11\n", None) and got["doc2.md"] == ("# 11 ü\n", None)
    assert {p: s for p, (t, s) in got.items() if s} == {"bin.dat": "binary", "latin.txt": "not_utf8", "big.txt": "too_large", "link.py": "outside"}
    assert rp.guarded_text(repos[0], "../two/doc0.md")[2] == "outside" and rp.guarded_text(repos[0], "none")[2] == "missing"


def test_pushed_filters_read_fewer_files(spark, repos):
    both = load(spark, "larkspan-files", ",".join(repos), slice=2)
    everything = both.rdd.getNumPartitions()
    some = both.where(F.col("path").startswith("src/") & (F.col("repo") == repos[0]) & (F.length("text") > 0))
    assert sorted(r["path"] for r in some.collect()) == ["src/a b.py", "src/new.py"]
    assert some.rdd.getNumPartitions() == 1 < everything
    assert both.where(F.col("path").isin("doc0.md", "doc1.md")).count() == 4
    reader = rp._FilesReader({"path": ",".join(repos)})
    rest = list(reader.pushFilters([rp.StringStartsWith(("path",), "src/"), rp.EqualTo(("size",), 3), rp.In(("repo",), (repos[1],))]))
    assert [f.attribute for f in rest] == [("size",)]
    assert [p.value["paths"] for p in reader.partitions()] == [["src/a b.py", "src/old.py"]]


def test_status_of_the_working_tree(spark, tmp_path):
    rp.register(spark)
    repo = make(tmp_path / "r", 2)
    run(repo, "mv", "src/old.py", "src/moved.py")
    (tmp_path / "r" / "doc0.md").write_text("changed")
    (tmp_path / "r" / "fresh file.txt").write_text("new")
    got = sorted((r["status"], r["path"]) for r in load(spark, "larkspan-status", repo).collect())
    assert got == [("??", "fresh file.txt"), ("M", "doc0.md"), ("R", "src/moved.py")]


@pytest.mark.parametrize("name", ["larkspan-history", "larkspan-files", "larkspan-status"])
def test_what_cannot_be_read_is_a_row(spark, repos, tmp_path, name):
    rows = load(spark, name, f"{repos[1]},{tmp_path}/none").collect()
    bad = [r for r in rows if r["repo"] == f"{tmp_path}/none"]
    assert len(bad) == 1 and any("none" in str(x) for x in bad[0][1:])
    assert name == "larkspan-status" or len(rows) > 1


def test_providers_fail_and_run_out_of_time_by_themselves(spark, tmp_path):
    rp.register(spark)
    (tmp_path / "some_providers.py").write_text(PROVIDERS)
    spark.addArtifact(str(tmp_path / "some_providers.py"), pyfile=True) if hasattr(spark, "_client") else spark.sparkContext.addPyFile(str(tmp_path / "some_providers.py"))
    names = [f"some_providers:{f}" for f in ("good", "broken", "slow", "none", "absent")] + ["no_such_module:f"]
    df = load(spark, "larkspan-search", None, providers=",".join(names), queries=json.dumps(["p", "q", "r", "s"]), budget=0.9, limit=3)
    assert df.rdd.getNumPartitions() == len(names)
    rows: dict = {}
    for r in df.collect():
        rows.setdefault(r["provider"].partition(":")[2] if "some" in r["provider"] else "module", []).append((r["query"], r["rank"], r["title"], r["error"]))
    assert [x[:3] for x in rows["good"][:4]] == [("p", 1, "p 0"), ("p", 2, "p 1"), ("p", 3, "p 2"), ("q", 1, "q 0")] and len(rows["good"]) == 12
    assert rows["broken"][:2] == [("p", 1, "one", None), ("p", None, None, "ValueError: no more")] and len(rows["broken"]) == 8
    assert rows["slow"][0][2] == "p" and rows["slow"][-1] == ("s", None, None, "budget")
    assert "none" not in rows and all("absent" in x[3] for x in rows["absent"]) and all("no_such_module" in x[3] for x in rows["module"])
    one = df.where(F.col("provider") == names[0])
    assert one.count() == 12 and one.rdd.getNumPartitions() == 1
