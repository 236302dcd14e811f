"""Ignore files as rows, against git itself."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from larkspan.operators import ignores


def verdicts(spark, files, paths, bases=()):
    rules = ignores.rule_rows(spark.createDataFrame(files, "path string, text string"), "path", "text")
    df = ignores.with_ignored(spark.createDataFrame([(p,) for p in paths], "path string"), "path", rules, bases)
    return {r["path"]: r["ignored"] for r in df.collect()}


FILES = [
    (".gitignore", "﻿# all\r\n*.log\n!keep.log\n/out/\ntmp\ndocs/*.md\n**/gen/*.js\n[a-c]?.dat\n\\#x\n*.tar.gz\n[!0-9]z\n"),
    ("a/.gitignore", "!deep.log\nonly/\nx/y\n"), ("a/b/.gitignore", "*\n!*.py\n"), ("tmp/.gitignore", "!kept\n"), ("none/.gitignore", None),
]
PATHS = [
    "s.log", "keep.log", "a/keep.log", "a/deep.log", "deep.log", "out/x", "a/out/x", "out", "tmp", "tmp/kept", "a/tmp/x", "docs/a.md", "docs/b/a.md", "gen/a.js",
    "p/q/gen/a.js", "a1.dat", "d1.dat", "#x", "x.tar.gz", "x.gz", "qz", "7z", "a/only", "a/only/f", "a/x/y", "a/q/x/y", "a/b/m.py", "a/b/m.c", "a/b/c/m.py", "none/f.log",
]


def test_named_cases(spark):
    got = verdicts(spark, FILES, PATHS)
    assert {p for p, v in got.items() if v} == {
        "s.log", "deep.log", "out/x", "tmp", "tmp/kept", "a/tmp/x", "docs/a.md", "gen/a.js", "p/q/gen/a.js", "a1.dat", "#x", "x.tar.gz", "qz", "a/only/f", "a/x/y",
        "a/b/m.c", "a/b/c/m.py", "none/f.log"}


def test_spared_bases_nulls_and_repeats(spark):
    rules = ignores.rule_rows(spark.createDataFrame([(".gitignore", "out\n*.log\n[z-a]\n")], "path string, text string"), "path", "text")
    files = spark.createDataFrame([("out/in/f", 1), ("out/in/f", 2), ("out/f.log", 3), (None, 4)], "path string, ignored_before int")
    got = sorted(tuple(r) for r in ignores.with_ignored(files, "path", rules, ("out/in",)).select("ignored_before", "ignored").collect())
    assert got == [(1, False), (2, False), (3, True), (4, False)]
    assert ignores.with_ignored(files.limit(0), "path", rules).count() == 0
    assert ignores.with_ignored(files, "path", rules.limit(0)).where("ignored").count() == 0


@pytest.mark.skipif(not shutil.which("git"), reason="no git here")
def test_random_trees_against_git(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    names = ["a", "b", "cc", "x.log", "y.tmp.log", "k.py", "build", "n1"]
    shapes = ["{}", "/{}", "{}/", "!{}", "!{}/", "*.log", "!x.log", "*.tmp.log", "b*", "?", "[a-b]", "[!a]", "{}/{}", "**/{}", "{}/**", "/{}/*", "*", "!*.py", "# {}", ""]
    paths = sorted({"/".join(rnd.choice(names) for _ in range(rnd.randint(1, 4))) for _ in range(700)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]  # a path is a file or a folder
    folders = sorted({"/".join(p.split("/")[:i]) for p in paths for i in range(p.count("/") + 1)})
    files = []
    for f in ["", *rnd.sample(folders[1:], 60)]:
        lines = [s.format(*[rnd.choice(names) for _ in range(2)]) for s in rnd.choices(shapes, k=rnd.randint(1, 4))]
        files.append(((f + "/" if f else "") + ".gitignore", "\n".join(lines)))
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    for p, text in files:
        (tmp_path / p).write_text(text)
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", "/dev/null")
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    said = subprocess.run(["git", "check-ignore", "--no-index", "--stdin"], cwd=tmp_path, input="\n".join(paths), capture_output=True, text=True).stdout
    want = set(said.split("\n")) - {""}
    got = {p for p, v in verdicts(spark, files, paths).items() if v}
    assert 50 < len(want) < len(paths) - 50
    assert got == want


def test_keys_are_joined_not_matched(spark):
    """Thousands of plain rules cost equality, not regular expressions, and give the same as globs of the same meaning."""
    plain = [(".gitignore", "\n".join(f"n{i}" for i in range(0, 4000, 2)))]
    rules = ignores.rule_rows(spark.createDataFrame(plain, "path string, text string"), "path", "text")
    assert rules.where(F.col("regex").isNotNull()).count() == 0
    got = verdicts(spark, plain, [f"d{i % 7}/n{i}" for i in range(4000)])
    assert {p for p, v in got.items() if v} == {f"d{i % 7}/n{i}" for i in range(0, 4000, 2)}
