"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept and applies its decision; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspan.llm import jaccard, langid, linededup, mixing, packing, simhash
from larkspan.session import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: null, empty and letterless texts, and noise by its parse.

    Texts of any length are parsed whole; repeated rows share their verdict; null ids and further columns pass through; an empty table stays empty.
    """
    return langid.identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share from all but one of them; ``n_chars`` follows the text.

    A null text stays null, an empty one empty, a very long one is split in one task; rows of a null id keep all lines; every row
    stays, repeated rows and further columns too; an empty table stays empty.
    """
    out = linededup.deduplicate_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The one of the smallest id stays, null ids last, ties by what the rows hold; repeated rows count once, texts without words are
    one group, very long texts are whole sets. Further columns pass through; an empty table stays empty.
    """
    return simhash.one_of_each(docs, jaccard.grouped(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their target weights.

    A null source is one, last in order; texts without words take nothing and go; repeated rows are rows of their own, and very
    long texts count whole. Further columns pass through; an empty table stays empty.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents into bins, each piece with its text; copies of one document never share a bin.

    Null and empty texts have no pieces, a text longer than a bin has several; null ids and repeated rows are packed like others;
    an empty table gives no bins.
    """
    return packing.pack_texts(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack),
]
#: Cross-parsing, connected components and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
