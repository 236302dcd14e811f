"""Line deduplication that moves hashes and bitmaps, never text.

Every line long enough is reduced to a 128-bit hash. The (hash, document,
position) rows are partitioned by equal ranges of the hash, each dealt over
lanes of documents that lie in different tasks, and sorted by hash, document
and position within. So the lines of one hash stream past together with the
largest document first, and a hash held by a third of all documents spreads
over its lanes. A window over the stream marks the first line of each document;
each lane reduces a hash to the number of those marks and its first document,
the lanes' results are merged, and each document receives a bitmap of the lines
that it loses.

A bitmap is run-compressed: an array of (first, last) positions of dropped
lines; whatever lies between the runs is kept.

Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larkspan.functions.text import let
from larkspan.llm import rows as keyed

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 40
MIN_DOCS = 5
#: Lanes of documents over which the lines of one hash are spread.
LANES = 16


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(hash, _id, r1, r2, pos) of every line whose key has at least ``min_chars`` code points."""
    line = F.btrim("line", F.lit(SPACE))
    ascii_only = F.octet_length("key") == F.length("key")  # lower() then touches A-Z alone, and is faster
    key = F.when(ascii_only, F.lower("key")).otherwise(F.translate("key", UPPER, LOWER))
    return (
        docs.select(F.col(id_col).alias("_id"), *keyed.key(id_col, text_col), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("_id", "r1", "r2", "pos", line.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.md5(key).alias("hash"), "_id", "r1", "r2", "pos")
    )


def drop_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, lanes: int = LANES,
) -> DataFrame:
    """(r1, r2, runs): for each text of an id that loses lines, the runs of positions it loses; r1 and r2 are the key of id and text.

    A line's key is the line with white space (0x20, 0x09-0x0D) stripped at both
    ends and A-Z lower-cased. Keys of at least ``min_chars`` code points found in
    at least ``min_docs`` documents (distinct ids) are lost by all documents but
    the one of the largest id, which keeps all its own. Rows of one id count as
    one document but have bitmaps of their own where their texts differ. A row
    with a null id neither loses lines nor counts; a null or empty text is one
    empty line; a very long text is split in one task. Empty tables give an
    empty result and other columns are not read, whatever their names.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # digests are uniform, so equal ranges of them need no sampling
    ranged = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32))
    lane = F.pmod(F.xxhash64("_id"), F.lit(lanes))
    rows = line_rows(docs.where(F.col(id_col).isNotNull()), id_col, text_col, min_chars).withColumns({
        "part": F.pmod(ranged + lane * max(1, n // lanes), F.lit(n)).cast("int"), "hash": F.unhex("hash"),
    })
    rows = rows.repartitionById(n, F.col("part"))
    # the order asks for all columns, so this reader and the next share one exchange
    stream = Window.partitionBy("part", "hash").orderBy(F.col("_id").desc(), "r1", "r2", "pos")
    first = F.coalesce(F.lag("_id").over(stream) != F.col("_id"), F.lit(True))
    marked = rows.select("hash", "part", "_id", first.alias("first")).where("first")
    by_lane = marked.groupBy("part", "hash").agg(F.count("*").alias("docs"), F.max("_id").alias("keeper"))
    spread = by_lane.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")).where(F.col("docs") >= min_docs)
    # joined by a part of the hash, so that both sides are exchanges of their own and Spark can split a hot line
    short = F.substring("hash", 2, 15).alias("short")
    lost = rows.select(short, "_id", "r1", "r2", "pos").join(spread.select(short, "keeper"), "short").where(F.col("_id") != F.col("keeper"))
    at = lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    first = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    return at.select("r1", "r2", F.arrays_zip(first.alias("first"), last.alias("last")).alias("runs"))


def _kept(text, runs):
    """The lines of ``text`` outside ``runs``, joined again."""
    def of(lines):
        before = lambda j: F.when(j == 0, 0).otherwise(F.get(runs, j - 1)["last"] + 1)
        until = lambda j: F.when(j == F.size(runs), F.size(lines)).otherwise(F.get(runs, j)["first"])
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda j: F.slice(lines, before(j) + 1, until(j) - before(j)))), "\n")

    return let(_lines(text), of)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as the struct ``row``, with ``kept`` (the text that stays) and ``runs`` (null for rows that lose nothing).

    Bitmaps are hashed against the shuffled documents, so text is not sorted.
    """
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), *keyed.key(id_col, text_col))
    joined = rows.join(bitmaps.hint("shuffle_hash"), ["r1", "r2"], "left")
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    return joined.select("row", "runs", F.when(F.col("runs").isNull(), text).otherwise(_kept(text, F.col("runs"))).alias("kept"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``; a null text stays null.

    Every row stays, repeated rows and rows of a null id too; columns of any
    names pass through. What counts as repeated is said at ``drop_bitmaps``.
    """
    out = apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, **options), id_col, text_col)
    text = F.when(F.col("row")[text_col].isNull(), F.lit(None)).otherwise(F.col("kept"))
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: line counts and the digest of the kept text of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    dropped = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select(
        "row.doc_id", F.size(_lines(F.col("row.text"))).cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), d AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, d.key IS NOT NULL AND k.doc_id <> d.keeper AS dropped
  FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
