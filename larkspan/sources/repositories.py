"""Repositories and search providers as Spark data sources.

``register(spark)`` makes four formats known, each read in parallel, with the
filters that Spark pushes down deciding what is read at all:

* ``larkspan-files``: tracked files with their text; ``repo`` and ``path`` are pushed down.
* ``larkspan-history``: commits without merges, newest first; ``repo`` is pushed down.
* ``larkspan-status``: the working tree's changes; ``repo`` is pushed down.
* ``larkspan-search``: rows of search providers; ``provider`` is pushed down.

The first three take the repositories as the path, several separated by
commas; they must be on storage that all executors mount. What cannot be read
becomes a row with an ``error`` (or ``skipped``), never a failed job.
"""

from __future__ import annotations

import importlib
import json
import os
import subprocess
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from larkspan.session import ship
from larkspan.sources.corpus import parse_history, parse_status

MAX_BYTES, MAX_COMMITS, TIMEOUT = 2 << 20, 2000, 60
#: Files and commits of a partition.
FILES, COMMITS = 500, 200


def git(repo: str, *args: str, timeout: int = TIMEOUT) -> str:
    """The output of a git command that reads ``repo``; paths are given as they are, not quoted."""
    run = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, timeout=timeout, check=False)
    if run.returncode:
        raise RuntimeError(run.stderr.decode("utf-8", "replace").strip()[:300] or f"git ended with {run.returncode}")
    return run.stdout.decode("utf-8", "replace")


def reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


class Part(InputPartition):
    """What one task reads."""

    def __init__(self, **what) -> None:
        super().__init__(what)


class _Pushed(DataSourceReader):
    """Takes equality, membership and prefix filters on the columns in ``takes``; Spark applies the others."""

    takes: tuple[str, ...] = ("repo",)

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}  # as Spark compares them
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in self.takes and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((column, "start" if isinstance(f, StringStartsWith) else "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def wanted(self, column: str, value: str) -> bool:
        """Whether the filters on a column let a value pass."""
        return all(value.startswith(v) if kind == "start" else value in v for c, kind, v in self.tests if c == column)

    def repos(self) -> list[str]:
        return [r for r in (x.strip() for x in self.options.get("path", "").split(",")) if r and self.wanted("repo", r)]


def guarded_text(root: str, path: str, most: int = MAX_BYTES) -> tuple[int | None, str | None, str | None]:
    """(size, text, why it has none) of a file that has to lie below ``root``, be a plain file, small, without NUL, and UTF-8."""
    full = os.path.join(root, path)
    try:
        if os.path.islink(full) or not os.path.realpath(full).startswith(os.path.realpath(root) + os.sep):
            return None, None, "outside"
        if not os.path.isfile(full):
            return None, None, "missing"
        size = os.path.getsize(full)
        if size > most:
            return size, None, "too_large"
        before = os.stat(full)
        with open(full, "rb") as f:
            data = f.read(most + 1)
        after = os.stat(full)
        # a file that changes while it is read is read again by the next run
        if (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size) or len(data) != after.st_size:
            return size, None, "changing"
    except OSError as e:
        return None, None, reason(e)
    if b"\0" in data:
        return size, None, "binary"
    try:
        return size, data.decode("utf-8"), None
    except UnicodeDecodeError:
        return size, None, "not_utf8"


class _FilesReader(_Pushed):
    takes = ("repo", "path")

    def partitions(self) -> list[Part]:
        out = []
        n = int(self.options.get("slice", FILES))
        for repo in self.repos():
            try:
                names = sorted(p for p in git(repo, "ls-files", "-z").split("\0") if p and self.wanted("path", p))
            except (RuntimeError, OSError, subprocess.SubprocessError) as e:
                out.append(Part(repo=repo, paths=[], error=reason(e)))
                continue
            out += [Part(repo=repo, paths=names[i : i + n], error=None) for i in range(0, len(names), n)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        what = partition.value
        if what["error"]:
            yield what["repo"], None, None, None, what["error"]
        for path in what["paths"]:
            yield what["repo"], path, *guarded_text(what["repo"], path, int(self.options.get("maxbytes", MAX_BYTES)))


class TrackedFiles(DataSource):
    """(repo, path, size, text, skipped) of the files that git tracks."""

    @classmethod
    def name(cls) -> str:
        return "larkspan-files"

    def schema(self) -> str:
        return "repo string, path string, size long, text string, skipped string"

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(dict(self.options))


_FIELDS = "--format=%x1e%H%x1f%at%x1f%s%x1f%b%x1f"


class _HistoryReader(_Pushed):
    def partitions(self) -> list[Part]:
        most, n, out = int(self.options.get("maxcommits", MAX_COMMITS)), int(self.options.get("slice", COMMITS)), []
        for repo in self.repos():
            try:
                commits = git(repo, "rev-list", "--no-merges", f"--max-count={most}", "HEAD").split()
                moves = git(repo, "log", "--no-merges", f"--max-count={most}", "--diff-filter=R", "-M", "--name-status", "--format=%x1e%H", "HEAD")
            except (RuntimeError, OSError, subprocess.SubprocessError) as e:
                out.append(Part(repo=repo, skip=0, count=0, names={}, error=reason(e)))
                continue
            # a slice starts with the names that the newer slices' renames gave to the files
            place, names, renamed = {c: i for i, c in enumerate(commits)}, {}, []
            for record in filter(str.strip, moves.split("\x1e")):
                head, *lines = record.strip("\n").split("\n")
                renamed += [(place[head], *line.split("\t")[1:3]) for line in lines if line.startswith("R") and head in place]
            renamed.sort(key=lambda r: r[0])
            at = 0
            for skip in range(0, len(commits), n):
                while at < len(renamed) and renamed[at][0] < skip:
                    _, old, new = renamed[at]
                    names[old] = names.get(new, new)
                    at += 1
                out.append(Part(repo=repo, skip=skip, count=min(n, len(commits) - skip), names=dict(names), error=None))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        what = partition.value
        repo, error = what["repo"], what["error"]
        if not error:
            try:
                raw = git(repo, "log", "--no-merges", f"--skip={what['skip']}", f"--max-count={what['count']}", "-M", "--name-status", _FIELDS, "HEAD")
            except (RuntimeError, OSError, subprocess.SubprocessError) as e:
                error = reason(e)
        if error:
            yield repo, None, None, None, None, None, None, error
            return
        for i, c in enumerate(parse_history(raw, what["names"])):
            yield repo, what["skip"] + i, c["hash"], c["time"], c["subject"], c["body"], c["files"], None


class History(DataSource):
    """(repo, nth, hash, time, subject, body, files, error) of the commits but merges, files under the names they have today."""

    @classmethod
    def name(cls) -> str:
        return "larkspan-history"

    def schema(self) -> str:
        return "repo string, nth int, hash string, time long, subject string, body string, files array<string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(dict(self.options))


class _StatusReader(_Pushed):
    def partitions(self) -> list[Part]:
        return [Part(repo=r) for r in self.repos()]

    def read(self, partition: Part) -> Iterator[tuple]:
        repo = partition.value["repo"]
        try:
            for status, path in parse_status(git(repo, "status", "--porcelain", "-z", "--untracked-files=all")):
                yield repo, status, path, None
        except (RuntimeError, OSError, subprocess.SubprocessError) as e:
            yield repo, None, None, reason(e)


class Status(DataSource):
    """(repo, status, path, error) of what differs from the last commit, untracked files included."""

    @classmethod
    def name(cls) -> str:
        return "larkspan-status"

    def schema(self) -> str:
        return "repo string, status string, path string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _StatusReader(dict(self.options))


#: A provider: rows of title, url and snippet for a query, best first.
Provider = Callable[[str], Iterable[dict]]


def provider(name: str) -> Provider:
    """The function that ``module:function`` names; adapters of providers are modules that need not know of Spark."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _SearchReader(_Pushed):
    takes = ("provider",)

    def partitions(self) -> list[Part]:
        names = [p for p in (x.strip() for x in self.options.get("providers", "").split(",")) if p and self.wanted("provider", p)]
        return [Part(provider=p, place=i) for i, p in enumerate(names)]

    def read(self, partition: Part) -> Iterator[tuple]:
        name, queries, most = partition.value["provider"], json.loads(self.options["queries"]), int(self.options.get("limit", 10))
        # options are strings, and the budget is one provider's for all queries
        ends = time.monotonic() + float(self.options.get("budget", 30))
        row = lambda query, n=None, title=None, url=None, snippet=None, error=None: (name, query, n, title, url, snippet, error)
        for query in queries:
            if time.monotonic() >= ends:
                yield row(query, error="budget")
                continue
            try:
                n = 0
                for hit in provider(name)(query):
                    n += 1
                    yield row(query, n, hit.get("title"), hit.get("url"), hit.get("snippet"))
                    if n >= most:
                        break
                    if time.monotonic() >= ends:
                        yield row(query, error="budget")
                        break
            except Exception as e:  # a provider's failure is its answer, whatever it raises
                yield row(query, error=reason(e))


class Search(DataSource):
    """(provider, query, rank, title, url, snippet, error): the rows of several providers, each a task with a budget of seconds.

    Options: ``providers`` (``module:function``, by commas), ``queries`` (a JSON array), ``budget``, ``limit``. Rows that
    came before a failure or the end of the budget stay.
    """

    @classmethod
    def name(cls) -> str:
        return "larkspan-search"

    def schema(self) -> str:
        return "provider string, query string, rank int, title string, url string, snippet string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and let Spark push filters to them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TrackedFiles, History, Status, Search):
        spark.dataSource.register(source)
