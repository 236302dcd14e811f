"""Ignore files as data: their lines are rows, met by equality wherever a rule allows it.

Most rules name a thing (``node_modules``), a place (``/build``) or an ending
(``*.log``); those are joined to the entries of the tree by key. Only the other
globs are matched as regular expressions, against the entries below their own folder.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from larkspan.operators.rules import glob_regex
from larkspan.session import ship

#: Rules up to this number are sent to all tasks; more are joined by shuffling.
SENT_RULES = 50_000
_WILD = "[*?\\[\\\\]"


@F.pandas_udf(StringType())
def _regex(glob: pd.Series) -> pd.Series:
    def one(g: str) -> str | None:
        try:
            return re.compile(glob_regex(g)).pattern
        except re.error:  # a class such as [z-a] matches nothing
            return None

    return glob.map(one, na_action="ignore")


def rule_rows(files: DataFrame, path: str, text: str) -> DataFrame:
    """(folder, pos, negated, folders_only, anchored, kind, key, regex): a row for each rule of ignore files.

    ``folder`` is the file's, "" at the root. ``kind`` says what ``key`` is equal to: an entry's ``name``, its ``path`` below
    the folder or an ``ending`` of its name that begins with a dot; a ``glob`` has a regular expression instead.
    Blank lines, comments and null texts give no rows.
    """
    ship(files.sparkSession)
    folder = F.regexp_replace(F.col(path), "/?[^/]*$", "")
    lines = files.select(folder.alias("folder"), F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), "\r?\n")).alias("pos", "line"))
    line = lines.select("folder", "pos", F.regexp_replace("line", "(?<!\\\\)[ \\t]+$", "").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    rule = F.when(F.col("negated"), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    r = line.withColumn("negated", F.col("line").startswith("!")).withColumn("rule", rule)
    r = r.withColumn("folders_only", F.col("rule").endswith("/")).withColumn("rule", F.regexp_replace("rule", "/$", ""))
    r = r.withColumn("anchored", F.contains("rule", F.lit("/"))).withColumn("rule", F.regexp_replace("rule", "^/", "")).where("rule <> ''")
    wild = F.col("rule").rlike(_WILD)
    kind = (
        F.when(~wild & F.col("anchored"), "path").when(~wild, "name")
        .when(~F.col("anchored") & F.col("rule").rlike("^\\*\\.[^*?\\[\\\\]+$"), "ending").otherwise("glob"))
    r = r.withColumn("kind", kind)
    key = F.when(F.col("kind") == "ending", F.expr("substring(rule, 2)")).when(F.col("kind") != "glob", F.col("rule")).otherwise("")
    return r.select(
        "folder", "pos", "negated", "folders_only", "anchored", "kind", key.alias("key"), _regex(F.when(F.col("kind") == "glob", F.col("rule"))).alias("regex"))


def _joined(parts: Column, start, n) -> Column:
    return F.array_join(F.slice(parts, start, n), "/")


def entries(files: DataFrame, path: str) -> DataFrame:
    """(entry, is_folder): every path and every folder above one, once."""
    parts = F.split(path, "/")
    each = files.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    return each.select(_joined(F.col("p"), 1, F.col("n")).alias("entry"), (F.col("n") < F.size("p")).alias("is_folder")).distinct()


def ignored_entries(tree: DataFrame, rules: DataFrame) -> DataFrame:
    """(entry, is_folder) of ``tree`` that rules ignore by themselves: of those that match, the last of the deepest file decides."""
    # an entry meets the rules of each folder above it that has some
    above = tree.select("entry", "is_folder", F.split("entry", "/").alias("p")).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("depth"))
    above = above.select(
        "entry", "is_folder", "depth", F.when(F.col("depth") == 0, "").otherwise(_joined(F.col("p"), 1, F.col("depth"))).alias("folder"),
        _joined(F.col("p"), F.col("depth") + 1, F.size("p")).alias("below"), F.element_at("p", -1).alias("name"))
    few = rules.limit(SENT_RULES + 1).count() <= SENT_RULES
    rules = F.broadcast(rules) if few else rules
    above = above.join(rules.select("folder").distinct(), "folder", "left_semi")
    dots = F.split("name", "\\.")
    endings = F.transform(F.sequence(F.lit(2), F.size(dots)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(dots, i, F.size(dots)), ".")))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.concat(
        F.array(pair("name", F.col("name")), pair("path", F.col("below")), pair("glob", F.lit(""))),
        F.when(F.size(dots) > 1, F.transform(endings, lambda e: pair("ending", e))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")))
    met = above.withColumn("k", F.explode(keys)).select("*", "k.kind", "k.key").drop("k").join(rules, ["folder", "kind", "key"])
    target = F.when(F.col("anchored"), F.col("below")).otherwise(F.col("name"))
    fits = (F.col("kind") != "glob") | F.coalesce(F.expr("rlike(target, regex)"), F.lit(False))
    met = met.withColumn("target", target).where((F.col("is_folder") | ~F.col("folders_only")) & fits)
    last = met.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("depth", "pos")).alias("negated"))
    return last.where("NOT negated").select("entry", "is_folder")


def with_ignored(files: DataFrame, path: str, rules: DataFrame, bases: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with ``ignored``: whether rules ignore the path or a folder above it.

    Nothing brings back what lies in an ignored folder, but ``bases`` and the folders above them are spared. A null path
    is not ignored; repeated paths keep their rows.
    """
    tree = entries(files.where(F.col(path).isNotNull()), path)
    spared = sorted({"/".join(b.strip("/").split("/")[: i + 1]) for b in bases for i in range(b.strip("/").count("/") + 1)})
    out = ignored_entries(tree.where(~F.col("entry").isin(spared)) if spared else tree, rules)
    paths = files.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct()
    each = paths.select("_path", F.explode(F.sequence(F.lit(1), F.size(F.split("_path", "/")))).alias("n"))
    each = each.select("_path", _joined(F.split("_path", "/"), 1, F.col("n")).alias("entry"), (F.col("n") < F.size(F.split("_path", "/"))).alias("is_folder"))
    hit = each.join(out, ["entry", "is_folder"]).select("_path").distinct()
    return files.join(hit.withColumn("_hit", F.lit(True)), files[path] == hit["_path"], "left").withColumn("ignored", F.col("_hit").isNotNull()).drop("_path", "_hit")
