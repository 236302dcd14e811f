"""Change history: hotspots, coupling, partners, glossary, decisions, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.session import materialize

MAX_CHANGESET, MIN_SHARED, MIN_REVISIONS, MIN_DEGREE = 30, 5, 5, 0.30
# Fixed value: wording that marks a decision.
DECISION = "(?i)\\b(decid\\w*|replac\\w*|switch\\w*|migrat\\w*|adopt\\w*|drop\\w*|instead of|introduc\\w*|because)\\b"
# Fixed value: manifests whose change marks a decision.
MANIFEST = "(^|/)(package\\.json|requirements[\\w.-]*\\.txt|go\\.mod|pom\\.xml|pyproject\\.toml|build\\.gradle(\\.kts)?)$"
# Fixed value: the words that an identifier is made of.
IDENTIFIER_WORD = "[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\\d+"


def hotspots(changes: DataFrame, sizes: DataFrame, file: str, commit: str, time: str, lines: str = "lines") -> DataFrame:
    """Files by commits times lines, files without lines left out; the last change is the newest commit's."""
    churn = changes.groupBy(file).agg(F.countDistinct(commit).alias("commits"), F.max(time).alias("last_change"))
    return churn.join(sizes.where(F.col(lines) > 0), file).withColumn("score", F.col("commits") * F.col(lines))


def coupling(
    changes: DataFrame, commit: str, file: str, max_changeset: int = MAX_CHANGESET, min_shared: int = MIN_SHARED,
    min_revisions: int = MIN_REVISIONS, min_degree: float = MIN_DEGREE,
) -> DataFrame:
    """(a, b, shared, degree) of files that change together: shared commits over the mean commits of the two.

    Commits of more than ``max_changeset`` files are skipped, so a commit never yields more than its square of pairs.
    """
    c = changes.select(F.col(commit).alias("_c"), F.col(file).alias("_f")).distinct()
    small = c.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") <= max_changeset)
    c = c.join(small.select("_c"), "_c")
    revisions = c.groupBy("_f").agg(F.count("*").alias("r"))
    pairs = c.alias("x").join(c.alias("y"), (F.col("x._c") == F.col("y._c")) & (F.col("x._f") < F.col("y._f")))
    shared = pairs.groupBy(F.col("x._f").alias("a"), F.col("y._f").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    out = shared.join(revisions.select(F.col("_f").alias("a"), F.col("r").alias("ra")), "a").join(revisions.select(F.col("_f").alias("b"), F.col("r").alias("rb")), "b")
    degree = F.col("shared") / ((F.col("ra") + F.col("rb")) / 2)
    return out.where((F.least("ra", "rb") >= min_revisions) & (degree >= min_degree)).select("a", "b", "shared", degree.alias("degree"))


def linked(pairs: DataFrame, imports: DataFrame, source: str, target: str) -> DataFrame:
    """``pairs`` with ``linked``: whether either file imports the other."""
    e = imports.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).distinct().withColumn("_l", F.lit(True))
    return pairs.join(e, ["a", "b"], "left").withColumn("linked", F.coalesce("_l", F.lit(False))).drop("_l")


def partners(pairs: DataFrame, changed: DataFrame, file: str) -> DataFrame:
    """Files coupled to the changed ones but not changed: one row each, the strongest pair."""
    ch = changed.select(F.col(file).alias("_f")).distinct()
    a = pairs.select(F.col("a").alias("changed"), F.col("b").alias("partner"), "shared", "degree")
    b = pairs.select(F.col("b").alias("changed"), F.col("a").alias("partner"), "shared", "degree")
    both = a.union(b).join(ch, F.col("changed") == F.col("_f"), "left_semi").join(ch, F.col("partner") == F.col("_f"), "left_anti")
    w = Window.partitionBy("partner").orderBy(F.col("degree").desc(), F.col("shared").desc(), "changed")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def glossary(names: DataFrame, name: str, key: str, least: int = 2, examples: int = 3, stop: tuple = ()) -> DataFrame:
    """(term, uses, examples): words of identifiers by how many use them, with the first few names."""
    word = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(name), F.lit(f"({IDENTIFIER_WORD})"), 1), F.lower)))
    t = names.select(F.col(key), F.col(name), word.alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(list(stop)))
    w = Window.partitionBy("term").orderBy(name, key)
    ranked = t.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy("term").agg(
        F.countDistinct(key).alias("uses"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= examples, F.struct("_rn", name)))), lambda x: x[name]).alias("examples"),
    ).where(F.col("uses") >= least)


def decision_signals(text: Column, manifest: Column, extra: str = "") -> Column:
    """Why a commit may record a decision, as an array; empty if it does not."""
    pattern = DECISION if not extra else DECISION[:-4] + f"|{extra})\\b"
    return F.array_compact(F.array(F.when(text.rlike(pattern), "wording"), F.when(manifest, "manifest")))


def rename_chain(renames: DataFrame, old: str, new: str, most: int = 50) -> DataFrame:
    """(old, current): where each renamed path ended up. One join for each step of the longest chain, halving as it doubles."""
    step = materialize(renames.select(F.col(old).alias("path"), F.col(new).alias("current")).where("path <> current"), "renames")
    for _ in range(most):
        hop = step.select(F.col("path").alias("current"), F.col("current").alias("further"))
        joined = materialize(step.join(hop, "current", "left").select("path", F.coalesce("further", "current").alias("current"), F.col("further").isNotNull().alias("moved")), "renames")
        step = joined.select("path", "current")
        if not joined.where("moved").limit(1).count():
            break
    return step


def release_groups(commits: DataFrame, tags: DataFrame, time: str, tag_time: str, tag: str) -> DataFrame:
    """Commits under the first tag at or after them, by time and name; null where unreleased.

    The tags are few: they travel as one sorted array beside the commits, which are not shuffled.
    """
    marks = tags.where(F.col(tag_time).isNotNull()).agg(F.sort_array(F.collect_list(F.struct(F.col(tag_time).alias("t"), F.col(tag).alias("tag")))).alias("_tags"))
    both = commits.crossJoin(F.broadcast(marks))  # one row
    later = F.filter("_tags", lambda x: x["t"] >= F.col(time))
    return both.withColumn("release", F.get(later, F.lit(0))["tag"]).select(*commits.columns, "release")
