"""Merkle manifests of a dataset by superblock reduction.

Every row is a leaf, every value of ``by`` a tree over its leaves in ascending
order, and the roots of the trees are the leaves of one tree more. A tree's
nodes are numbered, ``FANOUT ** LEVELS`` consecutive ones are a bucket, and
``applyInPandas`` collapses the ``LEVELS`` levels over each bucket at once to its
root; the roots of the buckets are the nodes of the next round, until every tree
has one. So a tree of any size takes a handful of rounds, no task sees more
than a bucket, and only the largest tree's size reaches the driver.

Proofs go the other way. A bucket's root knows the siblings on its way up; they
meet the bucket's nodes in one cogroup, where each node's own siblings inside
the bucket (the lower proof) are put before them (the upper proof). At the
leaves the proof is folded at once, so no table of whole proofs is written.

Numbers come from a range partitioning: positions within the sorted partitions
and the counts of the partitions before. Equal leaves are told apart by the
number that the row got when the leaves were written, so repeated rows may
fill any number of partitions.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.session import materialize, ship

FANOUT = 8
#: Levels that one round collapses: 512 nodes a bucket.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of monotonically_increasing_id() that count the rows of a partition.
_ROW_BITS = 33
_PATH = "left array<string>, right array<string>, subroot string, root string"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon, the value; a hyphen for null."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*[field(v) for v in values]), "UTF-8"), 256)


def digest(parts: list[str]) -> str:
    """The digest of a node over its children, or of a proof over its siblings."""
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels over ``n`` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The ``levels`` levels over consecutive ``nodes``, the nodes themselves first."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(stack: list[list[str]], at: int, fanout: int = FANOUT) -> tuple[list[str], list[str]]:
    """For node ``at`` of ``stack[0]``, level by level: its siblings to the left and to the right, joined."""
    left, right = [], []
    for level in stack[:-1]:
        first = at - at % fanout
        left.append("".join(level[first:at]))
        right.append("".join(level[at + 1 : first + fanout]))
        at //= fanout
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that a node has by its siblings."""
    for a, b in zip(left, right, strict=True):
        node = digest([a, node, b])
    return node


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``i``, each row's place in its tree by ``order`` from 0 on, and ``total``, the rows of the tree."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", _ROW_BITS).alias("part")
    counts = placed.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    found = placed.withColumn("part", part).join(starts, ["tree", "part"])
    return found.withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _bucket(levels: int, fanout: int) -> Column:
    return F.floor(F.col("i") / F.lit(fanout**levels)).cast("long").alias("bucket")


def reduced(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """The rounds (tree, i, node, total) over ``nodes``, which come first, down to one node for each tree."""
    size = fanout**levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        total = int(pdf["total"].iloc[0])
        stack = collapse(pdf["node"].tolist(), min(levels, height(total, fanout)), fanout)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "i": [int(pdf["i"].iloc[0]) // size], "node": stack[-1], "total": [-(-total // size)]})

    out = [nodes]
    left = nodes.agg(F.max("total")).first()[0] or 0
    while left > 1:
        up = out[-1].select("tree", "i", "node", "total", _bucket(levels, fanout)).groupBy("tree", "bucket")
        out.append(materialize(up.applyInPandas(run, "tree string, i long, node string, total long"), "superblocks"))
        left = -(-left // size)
    return out


def _with_paths(nodes: DataFrame, upper: DataFrame, fn, schema: str, levels: int, fanout: int) -> DataFrame:
    """``fn(rows, left, right, above)`` over each bucket: its nodes in order, the siblings of each inside it, and the bucket's own path."""
    def run(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        stack = collapse(pdf["node"].tolist(), min(levels, height(int(pdf["total"].iloc[0]), fanout)), fanout)
        pairs = [siblings(stack, k, fanout) for k in range(len(pdf))]
        return fn(pdf, [a for a, _ in pairs], [b for _, b in pairs], above.iloc[0])

    own = nodes.withColumn("bucket", _bucket(levels, fanout)).groupBy("tree", "bucket")
    return own.cogroup(upper.withColumnRenamed("i", "bucket").groupBy("tree", "bucket")).applyInPandas(run, schema)


def paths(rounds: list[DataFrame], upper: DataFrame, fn, schema: str, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``fn`` over the buckets of ``rounds[0]``, given the path of each tree's root (tree, i, left, right, subroot, root)."""
    def down(pdf: pd.DataFrame, left: list, right: list, above: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "tree": pdf["tree"], "i": pdf["i"], "left": [[*a, *above["left"]] for a in left], "right": [[*b, *above["right"]] for b in right],
            "subroot": above["subroot"], "root": above["root"],
        })

    for nodes in rounds[-2:0:-1]:
        upper = materialize(_with_paths(nodes, upper, down, f"tree string, i long, {_PATH}", levels, fanout), "paths")
    return _with_paths(rounds[0], upper, fn, schema, levels, fanout)


def manifest(
    docs: DataFrame, by: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, levels: int = LEVELS, fanout: int = FANOUT,
) -> DataFrame:
    """Leaf, roots and checked proof of every row of ``docs``.

    A leaf is the digest of ``fields``, each as its byte count, a colon and the
    value, or a hyphen for null. Per value of ``by`` the leaves ascend by
    ``id_col``, nulls first, ties by the leaf; every ``fanout`` consecutive nodes
    become one while several remain, a last run of one too. The roots of these
    trees (``subroot``), by the bytes of their value, null first, become ``root``
    in the same way. ``proof`` is the digest of the siblings on the way up.
    Rows for which ``tampered`` is true (null counts as false; none by default)
    are checked with the leaf of their text in ASCII lower case: ``folded_root``
    is the root that leaf and siblings give, and ``verified`` whether it is
    ``root``. A very long text is hashed whole where it is read; repeated rows
    have a leaf each; an empty table gives an empty result; columns that are
    not named are not read, whatever their names.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    values = [F.col(f"`{c}`") for c in fields]
    low = [ascii_lower(v) if c == text_col else v for c, v in zip(fields, values, strict=True)]
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # '=' before a value, so that null is a tree of its own and comes first
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit("")).alias("tree"), F.col(f"`{id_col}`").alias("_id"),
        leaf_digest(values).alias("node"), F.when(changed, leaf_digest(low)).alias("tampered"), F.monotonically_increasing_id().alias("nth"),
    )
    leaves = materialize(numbered(materialize(leaves, "leaves"), ["_id", "node", "nth"]).withColumn("_id", F.col("_id").cast("string")), "numbered")
    trees = reduced(leaves, levels, fanout)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    tops = materialize(numbered(tops, ["of"]), "tops")
    over = reduced(tops, levels, fanout)
    none = F.array().cast("array<string>")
    crown = over[-1].select("tree", "i", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("node").alias("root"))

    def top(pdf: pd.DataFrame, left: list, right: list, above: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "tree": pdf["of"], "i": 0, "left": [[*a, *above["left"]] for a in left], "right": [[*b, *above["right"]] for b in right],
            "subroot": pdf["node"], "root": above["root"],
        })

    upper = materialize(paths(over, crown, top, f"tree string, i long, {_PATH}", levels, fanout), "crown")

    def check(pdf: pd.DataFrame, left: list, right: list, above: pd.Series) -> pd.DataFrame:
        a, b = [[*x, *above["left"]] for x in left], [[*x, *above["right"]] for x in right]
        start = pdf["tampered"].where(pdf["tampered"].notna(), pdf["node"])
        return pd.DataFrame({
            "_id": pdf["_id"], "leaf": pdf["node"], "subroot": above["subroot"], "root": above["root"],
            "proof": [digest([s for pair in zip(x, y, strict=True) for s in pair]) for x, y in zip(a, b, strict=True)],
            "folded_root": [fold(n, x, y) for n, x, y in zip(start, a, b, strict=True)],
        })

    out = paths(trees, upper, check, "_id string, leaf string, subroot string, root string, proof string, folded_root string", levels, fanout)
    return out.select(
        F.col("_id").cast(id_type).alias(id_col), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the manifest of all ``documents``, a third of them tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")

