"""Rules over ``documents``, ``pages``, ``events`` and ``part``; paths are made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import ignores, rules as ru
from larkspan.plans.registry import query
from larkspan.session import table

_PATH_SQL = """CASE doc_id % 8 WHEN 0 THEN 'src/' || source || '/m' || doc_id || '.py' WHEN 1 THEN 'tests/test_' || doc_id || '.py' WHEN 2 THEN 'docs/' || lang || '/n' || doc_id || '.md'
  WHEN 3 THEN 'README.md' WHEN 4 THEN 'build/out' || doc_id || '.js' WHEN 5 THEN 'src/.cache/' || doc_id WHEN 6 THEN 'src/' || source || '/keep.log' ELSE 'src/' || source || '/x' || doc_id || '.log' END"""


def _paths(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", F.expr(_PATH_SQL).alias("path"))


@query("path_kinds", f"""
WITH p AS (SELECT {_PATH_SQL} AS path FROM documents)
SELECT CASE WHEN path = 'README.md' THEN 'doc' WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE 'docs/%' THEN 'doc' WHEN path LIKE 'build/%' THEN 'generated' ELSE 'code' END AS kind, count(*) AS n FROM p GROUP BY 1""")
def path_kinds(spark, d):
    return _paths(spark, d).groupBy(ru.path_kind(F.col("path"), [("build/", "generated")]).alias("kind")).agg(F.count("*").alias("n"))


@query("scope_filter", f"""
SELECT doc_id FROM (SELECT doc_id, {_PATH_SQL} AS path FROM documents)
WHERE (path LIKE 'src/%' OR path LIKE 'docs/%' OR path NOT LIKE '%/%') AND NOT regexp_matches(path, '(^|/)\\.[^/]+') AND NOT (path LIKE '%.log' AND path NOT LIKE '%/keep.log') AND path NOT LIKE 'docs/fr/%'""")
def scope_filter(spark, d):
    rules = ru.ignore_rules(["# logs", "*.log", "!keep.log"]) + ru.ignore_rules(["fr/"], "docs")
    return _paths(spark, d).where(ru.in_scope(F.col("path"), ["src", "docs"], ["build"], rules)).select("doc_id")


@query("credential_scan", """
SELECT 'assigned_token' AS kind, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '\\btoken = "[0-9a-f]{40}"') AND NOT regexp_matches(line, '(?i)\\b(example|sample|placeholder|dummy)\\b') HAVING count(*) > 0""")
def credential_scan(spark, d):
    return ru.credentials(table(spark, d, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("docs"))


_PORTS = "'host m' || (doc_id % 9) || chr(10) || 'listens on port ' || (doc_id * 37 % 90000) || ', then PORT: ' || (doc_id % 50 + 8000) || chr(10) || 'report 12345'"


@query("configuration_scan", f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split({_PORTS}, chr(10)) AS ls FROM documents)),
f AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '(?i)\\bport\\D{{0,3}}(\\d{{2,5}})\\b', 1)) AS name FROM l)
SELECT 'port' AS kind, name, list_sort(list(DISTINCT doc_id || ':' || pos)) AS places FROM f WHERE name::INT <= 65535 GROUP BY name""")
def configuration_scan(spark, d):
    text = F.expr(_PORTS.replace("chr(10)", "char(10)")).alias("text")
    return ru.configuration(table(spark, d, "documents").select("doc_id", text), "doc_id", "text").where("kind = 'port'")


@query("pattern_share", """
SELECT count(*) AS calls, avg((regexp_matches(event_type, '^(click|view)$'))::INT) AS share, avg((regexp_matches(event_type, '^(click|view)$'))::INT) > 0.25 AS broad FROM events""")
def pattern_share(spark, d):
    return ru.pattern_share(table(spark, d, "events"), "event_type", "^(click|view)$")


@query("matcher_overlap", """
SELECT event_type, count(*) AS matchers, list_sort(list(m)) AS which FROM (SELECT DISTINCT event_type FROM events), (VALUES ('click|view'), ('v.*'), ('error'), ('.*o.*')) t(m)
WHERE regexp_full_match(event_type, m) GROUP BY event_type HAVING count(*) > 1""")
def matcher_overlap(spark, d):
    m = spark.createDataFrame([("click|view",), ("v.*",), ("error",), (".*o.*",)], ["m"])
    return ru.matcher_overlap(m, table(spark, d, "events").select("event_type").distinct(), "m", "event_type")


@query("redirect_decisions", """
SELECT CASE WHEN event_type IN ('click', 'view') AND event_id % 2 = 0 AND len(regexp_extract_all(regexp_replace(props, '[\\\\^$.|?*+()\\[\\]{}]', ' ', 'g'), '\\w{2,}')) >= 1 THEN 'search' ELSE 'native' END AS decision, count(*) AS n FROM events GROUP BY 1""")
def redirect_decisions(spark, d):
    e = table(spark, d, "events")
    tool = F.when(F.col("event_type").isin("click", "view"), "grep").otherwise("read")
    return e.groupBy(ru.redirect(tool, F.concat(F.lit("find "), "props"), F.col("event_id") % 2 == 0).alias("decision")).agg(F.count("*").alias("n"))


@query("comment_runs", """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, pos, line, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l WHERE contains(line, '|') OR contains(line, '!!'))
SELECT doc_id, min(pos)::INT AS start, max(pos)::INT AS "end", length(string_agg(line, chr(10) ORDER BY pos)) AS chars FROM c GROUP BY doc_id, run""")
def comment_runs(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)
    runs = ru.merge_runs(lines.where(F.contains("line", F.lit("|")) | F.contains("line", F.lit("!!"))), ["doc_id"], "pos", "line")
    return runs.select("doc_id", "start", "end", F.length("text").cast("long").alias("chars"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_REMARKS = "CASE doc_id % 9 WHEN 0 THEN 'total = count + 1' WHEN 1 THEN 'see ABC-' || doc_id WHEN 2 THEN 'noqa: E' || doc_id WHEN 3 THEN '-----' WHEN 4 THEN 'return value;' WHEN 5 THEN 'added in the spring' END"
_COMMENTS = "string_split(text || coalesce(chr(10) || " + _REMARKS + ", ''), chr(10))"


@query("comment_findings", f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, {_COMMENTS} AS ls FROM documents)),
f AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, {_sql(ru.DIRECTIVE)}) OR regexp_matches(line, {_sql(ru.DIVIDER)}) THEN NULL
  WHEN regexp_matches(line, {_sql(ru.CODE_LINE)}) THEN 'commented_code' WHEN regexp_matches(line, {_sql("|".join(ru.HISTORY_TAG.split("|(?i)")[:1]))}) OR regexp_matches(line, {_sql("(?i)" + "|".join(ru.HISTORY_TAG.split("|(?i)")[1:]))}) THEN 'history_tag'
  WHEN pos > 0 AND length(line) > 120 THEN 'long_inline' END AS finding FROM l)
SELECT doc_id, pos::INT AS pos, finding FROM f WHERE finding IS NOT NULL""")
def comment_findings(spark, d):
    """Every line of a text as a comment, behind one made up for the purpose."""
    text = F.concat("text", F.coalesce(F.concat(F.lit("\n"), F.expr(_REMARKS)), F.lit("")))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    found = ru.comment_finding(F.col("line"), F.col("pos") > 0, F.lit(False), F.lit(1))
    return lines.select("doc_id", "pos", found.alias("finding")).where("finding IS NOT NULL")


@query("redirect_terms", r"""
WITH c AS (SELECT event_id, 'grep -rn --include=*.py "' || event_type || '_\w+(' || user_id || ')" src/' || event_type AS cmd FROM events),
w AS (SELECT event_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT event_id, regexp_split_to_array(trim(regexp_replace(cmd, '(?:^|\s)--?[\w-]+(?:=\S*)?|\\[bBdDsSwW]|[^\w\s]', ' ', 'g')), '\s+') AS ws FROM c)),
k AS (SELECT event_id, w, min(i) AS i FROM w WHERE length(w) >= 2 AND lower(w) NOT IN ('grep', 'rg', 'find', 'ack', 'cat', 'xargs', 'egrep') GROUP BY ALL)
SELECT event_id, list(w ORDER BY i) AS terms FROM k GROUP BY event_id""")
def redirect_terms(spark, d):
    command = F.concat(F.lit('grep -rn --include=*.py "'), "event_type", F.lit("_\\w+("), F.col("user_id").cast("string"), F.lit(')" src/'), "event_type")
    return table(spark, d, "events").select("event_id", ru.redirect_terms(command).alias("terms"))


@query("credential_lines", """
SELECT doc_id, pos::INT AS line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
WHERE regexp_matches(line, '\\btoken = "[0-9a-f]{40}"') AND NOT regexp_matches(line, '(?i)\\b(example|sample|placeholder|dummy)\\b')""")
def credential_lines(spark, d):
    """The lines behind ``credential_scan``."""
    return ru.credentials(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line")


@query("redirect_rows", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND event_id % 2 = 0 AND len(regexp_extract_all(regexp_replace(props, '[\\\\^$.|?*+()\\[\\]{}]', ' ', 'g'), '\\w{2,}')) >= 1 THEN 'search' ELSE 'native' END AS decision FROM events""")
def redirect_rows(spark, d):
    """The decisions behind ``redirect_decisions``."""
    e = table(spark, d, "events")
    tool = F.when(F.col("event_type").isin("click", "view"), "grep").otherwise("read")
    return e.select("event_id", ru.redirect(tool, F.concat(F.lit("find "), "props"), F.col("event_id") % 2 == 0).alias("decision"))


@query("validation_checks", """
WITH r AS (SELECT 'has_letters' AS "check", doc_id AS "where", regexp_matches(text, '[A-Za-z]') AS ok FROM documents UNION ALL
  SELECT 'n_chars', doc_id, n_chars = length(text) FROM documents UNION ALL SELECT 'long_enough', doc_id, n_chars >= 50 FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY "check", ok ORDER BY "where") AS rn FROM r)
SELECT "check", count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, round_even(avg(ok::INT), 4) AS score,
  coalesce(list("where" ORDER BY "where") FILTER (WHERE NOT ok AND rn <= 3), []) AS failures FROM k GROUP BY "check" """)
def validation_checks(spark, d):
    docs = table(spark, d, "documents")
    parts = [("has_letters", F.col("text").rlike("[A-Za-z]")), ("n_chars", F.col("n_chars") == F.length("text")), ("long_enough", F.col("n_chars") >= 50)]
    rows = docs.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col("doc_id").alias("where"), ok.alias("ok")) for n, ok in parts])).alias("r")).select("r.*")
    return ru.checks(rows)


@query("two_way_consistency", """
WITH a AS (SELECT DISTINCT l_suppkey AS x, l_partkey % 20 AS y FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_suppkey AS x, l_partkey % 20 AS y FROM lineitem WHERE l_linenumber >= 6)
SELECT x, y, 'b' AS missing_from FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT x, y, 'a' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def two_way_consistency(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 20).alias("y"), "l_linenumber")
    return ru.two_way(li.where("l_linenumber <= 2"), li.where("l_linenumber >= 6"), ["x", "y"])


@query("relation_sets", """
WITH s AS (SELECT l_suppkey AS s, list_sort(list(DISTINCT l_partkey % 50) FILTER (WHERE l_quantity > 48)) AS e, list_sort(list(DISTINCT l_partkey % 50) FILTER (WHERE l_quantity < 3)) AS l FROM lineitem GROUP BY l_suppkey)
SELECT s, list_sort(list_filter(e, lambda x: NOT list_contains(l, x))) AS lacks, list_sort(list_filter(l, lambda x: NOT list_contains(e, x))) AS extra FROM s
WHERE len(list_filter(e, lambda x: NOT list_contains(l, x))) > 0 OR len(list_filter(l, lambda x: NOT list_contains(e, x))) > 0""")
def relation_sets(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_partkey") % 50)
    sets = li.groupBy(F.col("l_suppkey").alias("s")).agg(F.collect_set(F.when(F.col("l_quantity") > 48, F.col("p"))).alias("e"), F.collect_set(F.when(F.col("l_quantity") < 3, F.col("p"))).alias("l"))
    return ru.set_difference(sets, "s", "e", "l")


_TREE = """'repo/' || coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || CASE doc_id % 5 WHEN 0 THEN 'build/' WHEN 1 THEN 'keep/' ELSE '' END || 'n' || doc_id
  || CASE doc_id % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.md' ELSE '.tmp.txt' END"""


@query("ignored_paths", f"""
WITH p AS (SELECT *, {_TREE} AS path FROM documents), m AS (SELECT source, min(lang) AS first FROM documents GROUP BY source), g AS (SELECT source, lang, max(doc_id) % 10 AS d FROM documents GROUP BY ALL)
SELECT doc_id, path, (doc_id % 3 = 0 AND NOT starts_with(doc_id || '', d || '')) OR (doc_id % 5 = 0 AND p.lang IS NOT DISTINCT FROM first AND first IS NOT NULL) AS ignored
FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.lang IS NOT DISTINCT FROM g.lang""")
def ignored_paths(spark, d):
    """Paths of all documents under an ignore file for each source and one for each of its languages."""
    docs = table(spark, d, "documents")
    top = F.concat(F.lit("repo/"), F.coalesce("source", F.lit("-")), F.lit("/"))
    of_source = docs.groupBy("source").agg(F.min("lang").alias("l")).select(
        F.concat(top, F.lit(".gitignore")).alias("path"), F.concat(F.lit("# logs\n*.log\n"), F.coalesce(F.concat(F.lit("/"), "l", F.lit("/build/\n")), F.lit(""))).alias("text"))
    of_lang = docs.groupBy("source", "lang").agg((F.max("doc_id") % 10).cast("string").alias("d")).select(
        F.concat(top, F.coalesce("lang", F.lit("-")), F.lit("/.gitignore")).alias("path"), F.concat(F.lit("keep\n!keep\n!n"), "d", F.lit("*.log")).alias("text"))
    rules = ignores.rule_rows(of_source.union(of_lang), "path", "text")
    return ignores.with_ignored(docs.select("doc_id", F.expr(_TREE).alias("path")), "path", rules)
