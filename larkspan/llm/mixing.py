"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, the ratio of
the source's target to its size. The documents of a source are laid out in an
order that sorts them by size, their expected copies are summed along it, one
random offset is added, and a document is emitted once for each integer that
its stretch of the running sum crosses. Sorting by size makes the words taken
follow the target closely whatever the distribution of sizes.

The rank of a document needs no sort of a whole source: it is the number of
rows in earlier (size class, lane) cells, a running sum over a small table of
counts, plus the rank within its own cell. A hot source spreads over its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from larkspan.llm import rows as keyed
from larkspan.session import materialize

LANES = 16
WEIGHTS = (3, 1, 2)
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "larkspan-mix"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with the column ``target``.

    Sources in code point order, null last, take ``weights`` in turn. The
    weights share ``share`` of all sizes; a target stops at ``cap`` times its
    source's size and the excess is shared again by weight until none is above.
    In order of cap to weight, a source is capped exactly if its part of what
    the sources before it leave over exceeds its cap.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    t = t.withColumns({
        "_all": F.sum("source_size").over(whole),
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    t = t.withColumn("_capped", (share * F.col("_all") - F.col("_before")) * F.col("_w") > F.col("_cap") * F.col("_rest"))
    t = t.withColumns({
        "_left": share * F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(whole), F.lit(0.0)),
        "_free": F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(whole),
    })
    return t.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.col("_left") / F.col("_free")).alias("target"))


def _copies(rows: DataFrame, weights: tuple, share: float, cap: float, seed: str) -> DataFrame:
    """``rows`` (_id, source, size, lane, ...) with source_size, target and copies."""
    rows = rows.withColumn("_class", F.floor(F.sqrt("size")))
    cells = rows.groupBy("source", "_class", "_lane").agg(F.count("*").alias("_c"), F.sum("size").alias("_b"))
    goal = targets(cells.groupBy("source").agg(F.sum("_b").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("_class", "_lane").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).alias("c")
    goal = goal.alias("t")
    plan = cells.join(goal, F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("c.source").alias("_src"), F.col("_class").alias("_k1"), F.col("_lane").alias("_k2"), "_start", "source_size", "target",
    )
    here = Window.partitionBy("source", "_class", "_lane").orderBy("_id", "size", *[c for c in ("r1", "r2") if c in rows.columns])
    ranked = rows.withColumn("_n", F.row_number().over(here)).join(
        plan, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_class") == F.col("_k1")) & F.col("_lane").eqNullSafe(F.col("_k2")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    ranked = ranked.withColumns({"_r": rate, "_u": offset, "_k": F.col("_start") + F.col("_n")})
    crossed = F.floor(F.col("_u") + F.col("_k") * F.col("_r")) - F.floor(F.col("_u") + (F.col("_k") - 1) * F.col("_r"))
    return ranked.withColumn("copies", F.least(crossed, F.ceil(F.lit(float(cap)))).cast("long"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, lanes: int, *more) -> DataFrame:
    integral = isinstance(docs.schema[id_col].dataType, IntegralType)
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more,
    ), "sizes")
    return rows.withColumn("_lane", F.pmod(F.col("_id") if integral else F.xxhash64("_id"), F.lit(lanes)))


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = SEED, lanes: int = LANES,
) -> DataFrame:
    """(id, size, source_size, target, copies) for every row of ``docs``.

    Size is the number of runs other than 0x20 and 0x09-0x0D in the text; a null
    or empty text has size 0, a very long one is a row like any other. A null
    source is a source of its own, the last. A source without words has target
    0, an empty table gives an empty result, repeated rows are separate rows of
    the mix, null ids are ids like any other, and other columns are not read,
    whatever their names. Documents of one size are taken in the order of
    their lanes and ids. No row gets more copies than ``cap`` rounded up. The
    same rows, lanes and seed give the same copies.

    ``lanes`` spreads documents of one source and size class; give it more
    where a class of a source has more rows than a task should sort.
    """
    rows = _sizes(docs, id_col, text_col, source_col, lanes)
    return _copies(rows, weights, share, cap, seed).select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = SEED, lanes: int = LANES,
) -> DataFrame:
    """``docs`` with every row as often as ``copies`` says, all its columns with it.

    Rows are told apart by all their columns, so null and repeated ids and
    clashing column names need no care; rows equal in all of them share what
    they get together. Null, empty and very long texts, ties and empty tables
    are as for ``copies``.
    """
    rows = _sizes(docs, id_col, text_col, source_col, lanes, *keyed.whole_key(docs))
    taken = _copies(rows, weights, share, cap, seed).groupBy("r1", "r2").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    return keyed.repeat(docs, taken)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: words taken from each of all ``documents``."""
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, encode(source) NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, encode(source) NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), c AS (SELECT *, (1.5::DOUBLE * total - before) * w > cap * rest AS capped FROM o
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
         w * (1.5::DOUBLE * total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / sum(w) FILTER (WHERE NOT capped) OVER () END AS target
  FROM c
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r,
         ('0x' || substr(md5('{SEED}' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size)), doc_id % {LANES}, doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(u + k * r) - floor(u + (k - 1) * r), 2) * size)::BIGINT AS taken
FROM k
"""
