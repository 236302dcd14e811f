"""Rows as what they hold, where ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType


def key(*columns: str) -> list[Column]:
    """A 128-bit key of a row's values, in the columns r1 and r2; nulls differ from everything else."""
    cols = [F.col(c) for c in columns]
    null = [F.isnull(c) for c in cols]
    return [F.xxhash64(*cols, *null).alias("r1"), F.xxhash64(F.lit(1), *null, *cols[::-1]).alias("r2")]


def _comparable(kind) -> bool:
    if isinstance(kind, ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def whole_key(docs: DataFrame) -> list[Column]:
    """The key of all columns that have an equality: rows that share it are copies."""
    return key(*(f"`{f.name}`" for f in docs.schema.fields if _comparable(f.dataType)))


def look_up(docs: DataFrame, side: DataFrame, keys: list[Column]) -> DataFrame:
    """``docs`` as the struct ``row``, with the columns of ``side`` (r1, r2, ...), for the rows that have one.

    The side is hashed, so text is not sorted; inside ``row`` the caller's column names cannot clash.
    """
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), *keys).join(side.hint("shuffle_hash"), ["r1", "r2"])


def repeat(docs: DataFrame, times: DataFrame) -> DataFrame:
    """``docs`` with every row as often as ``times`` (r1, r2 of the whole row, n, copies) says.

    ``n`` rows share a key and ``copies`` is what they are to become together; rows that share one are folded first.
    """
    found = look_up(docs, times.where("copies > 0"), whole_key(docs))
    many = found.where("n > 1").groupBy("r1", "r2").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    rows = found.where("n = 1").select("row", "copies").union(many.select("row", "copies"))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("nth")).select("row.*")
