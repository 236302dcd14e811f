"""Code facts: symbols, imports and calls of Python sources, references of markup, and their resolution by joins."""

from __future__ import annotations

import ast
import difflib
import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.session import ship
from larkspan.sources.corpus import explode_files

FACT = "fact string, name string, detail string, line int, end_line int"


def python_facts(source: str) -> list[tuple[str, str, str, int, int]]:
    """Facts of one source: ``symbol`` (qualified name, kind), ``import`` (name bound, module), ``call`` (enclosing symbol, expression).

    A source that does not parse has none.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str, int, int]] = []

    def visit(node: ast.AST, scope: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = (*scope, child.name)
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append(("symbol", ".".join(name), kind, child.lineno, child.end_lineno or child.lineno))
                visit(child, name)
                continue
            if isinstance(child, ast.Import):
                out.extend(("import", a.asname or a.name, a.name, child.lineno, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                out.extend(("import", a.asname or a.name, f"{base}.{a.name}".replace("..", ".") if base.strip(".") else base + a.name, child.lineno, child.lineno) for a in child.names)
            elif isinstance(child, ast.Call):
                try:
                    target = ast.unparse(child.func)
                except (ValueError, RecursionError):
                    target = ""
                if re.fullmatch(r"[\w.]+", target):
                    out.append(("call", ".".join(scope), target, child.lineno, child.end_lineno or child.lineno))
            visit(child, scope)

    visit(tree, ())
    return out


def facts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, fact, name, detail, line, end_line) of every file; each file is parsed by one task, on its own."""
    return explode_files(files, python_facts, path, text, FACT)


def resolve_calls(facts_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls (source, target, line), unresolved (path, line, expression, reason)).

    A name is looked up in its own file, then through an import to the file that
    the module's dotted path names; several candidates leave it unresolved.
    """
    s = facts_.where("fact = 'symbol'").select("path", F.col("name").alias("symbol"))
    calls = facts_.where("fact = 'call'").select("path", F.col("name").alias("caller"), F.col("detail").alias("expr"), "line").withColumn("_id", F.monotonically_increasing_id())
    own = calls.join(s, (calls["path"] == s["path"]) & (calls["expr"] == s["symbol"])).select("_id", calls["path"].alias("to_path"), "symbol", F.lit(0).alias("order"))
    method = calls.where(F.col("expr").startswith("self.")).withColumn("_m", F.concat(F.substring_index("caller", ".", 1), F.lit("."), F.substring_index("expr", ".", -1)))
    method = method.join(s, (method["path"] == s["path"]) & (F.col("_m") == F.col("symbol"))).select("_id", method["path"].alias("to_path"), "symbol", F.lit(0).alias("order"))
    imports = facts_.where("fact = 'import'").select(F.col("path").alias("_p"), F.col("name").alias("bound"), F.col("detail").alias("module"))
    head = F.substring_index("expr", ".", 1)
    via = calls.join(imports, (F.col("path") == F.col("_p")) & (head == F.col("bound")))
    full = F.concat("module", F.substring(F.col("expr"), F.length("bound") + 1, F.length("expr")))
    via = via.withColumn("_full", F.regexp_replace(full, "^\\.+", ""))
    dotted = s.select("path", "symbol", F.concat(F.regexp_replace(F.regexp_replace("path", "(/__init__)?\\.py$", ""), "/", "."), F.lit("."), F.col("symbol")).alias("_dotted"))
    far = via.join(dotted.withColumnRenamed("path", "to_path"), F.col("_full") == F.col("_dotted")).select("_id", "to_path", "symbol", F.lit(1).alias("order"))
    hits = own.union(method).union(far).distinct()
    best = hits.withColumn("_least", F.min("order").over(Window.partitionBy("_id"))).where("order = _least")
    n = best.groupBy("_id").agg(F.count("*").alias("n"), F.min(F.struct("to_path", "symbol")).alias("t"))
    joined = calls.join(n, "_id", "left")
    source = F.concat_ws("::", "path", F.when(F.col("caller") != "", F.col("caller")))
    ok = joined.where("n = 1").select(source.alias("source"), F.concat_ws("::", "t.to_path", "t.symbol").alias("target"), "line")
    why = F.when(F.col("n").isNull(), "unknown name").otherwise("several candidates")
    return ok, joined.where("n IS NULL OR n > 1").select("path", "line", F.col("expr").alias("expression"), why.alias("reason"))


_REFERENCE = (
    (re.compile(r"""(?:href|src)\s*=\s*["']([^"']+)["']""", re.I), "markup"), (re.compile(r"""url\(\s*["']?([^"')]+)["']?\s*\)|@import\s+["']([^"']+)["']""", re.I), "style"),
    (re.compile(r"""!?\[[^]]*\]\(\s*<?([^)\s>]+)"""), "markdown"),
)


def references(text: str) -> list[tuple[str, int, str]]:
    """(target, line, kind) of links in HTML, CSS and Markdown; fenced and inline code is skipped."""
    out, fence = [], None
    for n, line in enumerate(text.split("\n"), 1):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (fence is None or mark[1].startswith(fence)):
            fence = None if fence else mark[1][:3]
            continue
        if fence:
            continue
        line = re.sub(r"`[^`]*`", "", line)
        for pattern, kind in _REFERENCE:
            out += [(next(g for g in m.groups() if g), n, kind) for m in pattern.finditer(line)]
    return out


def _join_path(base: str, target: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), target.split("#")[0].split("?")[0]))


def reference_edges(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, target, line, kind, resolution): external, resolved to a file of the table, or unresolved."""
    ship(files.sparkSession)
    rows = explode_files(files, references, path, text, "target string, line int, kind string")

    def run(batches):
        for pdf in batches:
            out = [_join_path(p, t) if not t.startswith("/") else posixpath.normpath(t).lstrip("/") for p, t in zip(pdf[path], pdf["target"], strict=True)]
            yield pdf.assign(resolved=pd.Series(out, index=pdf.index, dtype=object))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    local = rows.mapInPandas(run, f"{kinds}, resolved string")
    known = files.select(F.col(path).alias("resolved"), F.lit(True).alias("_there")).distinct()
    out = local.join(known, "resolved", "left")
    external = F.col("target").rlike("^([a-z][a-z0-9+.-]*:|//)")
    how = F.when(external, "external").when(F.col("target").startswith("#") | F.col("_there"), "resolved").otherwise("unresolved")
    return out.select(path, "target", "line", "kind", how.alias("resolution"))


def touched_lines(before: str, after: str) -> list[int]:
    """Lines of ``after`` that are new or changed, and those beside which lines were taken out."""
    out: set[int] = set()
    for tag, _, _, j1, j2 in difflib.SequenceMatcher(None, before.split("\n"), after.split("\n"), autojunk=False).get_opcodes():
        if tag in ("replace", "insert"):
            out.update(range(j1 + 1, j2 + 1))
        elif tag == "delete":
            out.add(max(1, j1))
    return sorted(out)


def unified_diff(before: str, after: str, lines: int = 1000, chars: int = 128_000) -> str:
    text = "\n".join(list(difflib.unified_diff(before.split("\n"), after.split("\n"), "before", "after", lineterm=""))[:lines])
    return text[:chars]


def fixture_users(fixtures: DataFrame, tests: DataFrame) -> DataFrame:
    """(folder, test): tests below a folder whose parameters name one of its fixtures.

    ``fixtures`` (folder, names), ``tests`` (test, path, parameters); joined on the explode of names, then on the folder.
    """
    f = fixtures.select("folder", F.explode("names").alias("_n"))
    t = tests.select("test", "path", F.explode("parameters").alias("_n"))
    return t.join(f, "_n").where(F.col("path").startswith(F.concat(F.col("folder"), F.lit("/")))).select("folder", "test").distinct()


def nearest_file(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, literal, target): the existing file that a string literal names, tried from the literal's own folder upwards."""
    up = F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> struct(i AS step, array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1 - i), '/') AS folder))")
    tries = mentions.select("path", "literal", F.explode(up).alias("u")).select("path", "literal", "u.step", F.regexp_replace(F.concat_ws("/", "u.folder", "literal"), "^/", "").alias("target"))
    hit = tries.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("path", "literal").agg(F.min_by("target", "step").alias("target"))


def deepest_project(items: DataFrame, projects: DataFrame, path: str, root: str) -> DataFrame:
    """``items`` with the longest project root that holds the path: a join on ancestors, so no prefix is scanned for."""
    ancestors = F.expr(f"transform(sequence(1, size(split({path}, '/'))), i -> array_join(slice(split({path}, '/'), 1, i), '/'))")
    up = items.select(path, F.explode(ancestors).alias(root)).distinct().join(projects.select(root).distinct(), root)
    best = up.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return items.join(best, path, "left")


def version_key(v: Column) -> Column:
    """A version as an array of numbers, to compare by."""
    return F.transform(F.slice(F.regexp_extract_all(v, F.lit("(\\d+)"), 1), 1, 4), lambda x: x.cast("long"))


def satisfies(spec: Column, version: Column) -> Column:
    """Whether a version meets an exact, caret, tilde or comparison specifier."""
    want, have = version_key(spec), version_key(version)
    major = F.get(want, F.lit(0)) == F.get(have, F.lit(0))
    minor = major & F.get(want, F.lit(1)).eqNullSafe(F.get(have, F.lit(1)))
    return (
        F.when(spec.startswith("^"), major & (have >= want)).when(spec.startswith("~"), minor & (have >= want)).when(spec.startswith(">="), have >= want)
        .when(spec.startswith("<="), have <= want).when(spec.startswith(">"), have > want).when(spec.startswith("<"), have < want)
        .when(spec.rlike("^\\s*(\\*|latest)?\\s*$"), True).otherwise(F.slice(have, F.lit(1), F.size(want)) == want)
    )


def locked_versions(deps: DataFrame, lock: DataFrame) -> DataFrame:
    """(ecosystem, name, specifier, version): the highest locked version that meets the specifier; null if none does."""
    lk = lock.select("ecosystem", "name", F.col("version").alias("_v"))
    hit = deps.join(lk, ["ecosystem", "name"]).where(satisfies(F.col("specifier"), F.col("_v")))
    best = hit.groupBy("ecosystem", "name", "specifier").agg(F.max_by("_v", version_key(F.col("_v"))).alias("version"))
    return deps.join(best, ["ecosystem", "name", "specifier"], "left")


def advisories(deps: DataFrame, cache: DataFrame, now: Column, hours: int = 6) -> tuple[DataFrame, DataFrame]:
    """(known advisories of deps, deps that must be asked for): cached answers count for ``hours``."""
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("checked_at") <= hours * 3600)
    return deps.join(live, ["ecosystem", "name", "version"]), deps.join(live, ["ecosystem", "name", "version"], "left_anti")


def report_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state): new, resolved or still there."""
    a, b = old.select(key, F.lit(1).alias("_a")), new.select(key, F.lit(1).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "resolved").otherwise("same").alias("state"))


def orphan_candidates(orphans: DataFrame, features: DataFrame, key: str, feature: str, embedding: str = "embedding", k: int = 2) -> DataFrame:
    """The ``k`` features most like each function that belongs to none."""
    from larkspan.operators.retrieval import knn

    return knn(orphans.select(key, embedding), features.select(feature, embedding), k, key, feature, embedding)
