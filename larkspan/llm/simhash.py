"""SimHash near-duplicates through a popcount embedding.

A 64-bit fingerprint is cut into 32 segments of 2 bits and embedded as the
vector of their bit counts. Flipping a bit moves one coordinate by one, so the
Manhattan distance of two vectors never exceeds the Hamming distance of the
fingerprints and serves as a lower bound.

Candidates come from a grid range-join on that bound. The coordinates are dealt
into ``BLOCKS`` blocks. If the vectors of two fingerprints are within
Manhattan distance ``r``, at most ``r`` blocks differ, so the two share the
grid cell formed by some ``BLOCKS - r`` whole blocks; every such choice of
blocks is one grid, and points of one cell of one grid are compared: first by
the bound, then exactly.

Components are asked for, so the pairs of a family are not listed. First each
point is compared with the least of its cell; only cells that still hold several
components are then joined with themselves, across components, and what leaves the join is
one row for each two components that meet.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import graphs, linking, rows as keyed
from larkspan.session import materialize, ship

WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
BLOCKS = 7
_EVEN = 0x5555555555555555


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of ``text``; 0 where it has no words."""
    w = WORD.findall(text.translate(_LOWER)) if text else []
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < words else map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    total, n, part = np.zeros(64, np.int64), 0, []

    def add() -> None:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total.__iadd__(bits.sum(axis=0, dtype=np.int64))

    for s in shingles:
        part.append(digest(s, 42))
        if len(part) == 4096:
            n += len(part)
            add()
            part.clear()
    n += len(part)
    if part:
        add()
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def of_sets(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each set of 64-bit hashes; 0 of an empty one."""
    out = np.zeros(len(at) - 1, np.uint64)
    # sets in runs of about 65,536 hashes, or one larger set alone, bit by bit: what is held is a byte a hash
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 16), side="right")) - 1)
        h, first = hashes[at[i] : at[j]], at[i : j + 1] - at[i]
        some = np.flatnonzero(np.diff(first))
        for k in range(64) if len(some) else ():
            ones = np.add.reduceat((h >> np.uint64(k)).astype(np.uint8) & 1, first[:-1][some], dtype=np.int64)
            out[i + some] |= (2 * ones > np.diff(first)[some]).astype(np.uint64) << np.uint64(k)
        i = j
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(_id, r1, r2, fp): id, key of id and text, and SimHash of every whole text as a signed 64-bit integer."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(3)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps.view(np.int64))], names=["_id", "r1", "r2", "fp"])

    src = docs.select(F.col(id_col).alias("_id"), *keyed.key(id_col, text_col), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"_id {id_type}, r1 long, r2 long, fp long")


def embedding(fp):
    """The bit counts of the 32 segments, packed as 2-bit numbers of one 64-bit integer."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    low = fp.bitwiseAND(F.lit(_EVEN))
    both, one = high.bitwiseAND(low), high.bitwiseXOR(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a, b):
    """Manhattan distance of two packed embeddings: |x - y| of 0, 1, 2 in each 2-bit field.

    The field's values are 00, 01 and 10, so the exclusive or has both bits set
    exactly where 1 meets 2 (distance 1), and otherwise spells the distance.
    """
    x = a.bitwiseXOR(b)
    high, low = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_EVEN)), x.bitwiseAND(F.lit(_EVEN))
    one = low
    two = high.bitwiseAND(F.bitwise_not(low))
    return F.bit_count(one) + 2 * F.bit_count(two)


def grids(radius: int, blocks: int = BLOCKS) -> list[int]:
    """For each grid the mask of the packed coordinates that make its cells (signed)."""
    cut = [round(i * 32 / blocks) for i in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(cut[i], cut[i + 1])) for i in range(blocks)]
    out = [reduce(int.__or__, c) for c in combinations(masks, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _near(a, b, radius: int):
    """Whether two fingerprints differ in at most ``radius`` bits, by the bound first."""
    return (manhattan(embedding(a), embedding(b)) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def held_cells(points: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(fp, cell, least) of the distinct ``fp`` of ``points``, one row for each of its cells that holds others too; ``least`` is the cell's least.

    Cells are counted by their number alone. A map of a fixed size names those of several points; it may let others pass,
    more of them the more there are, and a join on the cell drops them. So a point is shuffled for few of its cells.
    """
    ship(points.sparkSession)
    pc = embedding(F.col("fp"))
    cells = points.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), pc.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(grids(radius, blocks))
    ])).alias("cell"))
    # counts are written before they are joined back, so that Spark can split a hot cell
    several = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "several")
    shared = points.sparkSession.sparkContext.broadcast(linking.bit_map(several.select(F.col("cell").alias("r1"))))  # MAP_BITS bits

    def run(batches):
        bits = shared.value
        for b in batches:
            yield b.filter(pa.array(linking.in_map(b.column(1).to_numpy().view(np.uint64), bits)))

    some = materialize(cells.mapInArrow(run, "fp long, cell long").join(several, "cell"), "some")
    return materialize(some.join(materialize(some.groupBy("cell").agg(F.min("fp").alias("least")), "firsts"), "cell"), "held")


def _met(points: DataFrame, radius: int, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(u, v) of points near the least of their cell, the components that these give, and (c, d, u, v): one pair for each two components that meet."""
    held = held_cells(points, radius, blocks)
    star = held.where((F.col("fp") != F.col("least")) & _near(F.col("fp"), F.col("least"), radius)).select(F.col("fp").alias("v"), F.col("least").alias("u")).distinct()
    star = materialize(star, "star")
    found = graphs.components(star)
    labelled = held.select("fp", "cell").join(found, F.col("fp") == F.col("node"), "left").select("fp", "cell", F.coalesce("component", "fp").alias("c"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("cell")
    apart = materialize(labelled.join(materialize(mixed, "mixed"), "cell"), "apart")
    meet = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.c") < F.col("b.c")) & _near(F.col("a.fp"), F.col("b.fp"), radius)
    pair = F.min(F.struct(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))).alias("p")
    more = apart.alias("a").join(apart.alias("b"), meet).groupBy(F.col("a.c").alias("c"), F.col("b.c").alias("d")).agg(pair)
    return star, found, more.select("c", "d", "p.u", "p.v")


def pairs(points: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(u, v) of the distinct ``fp`` of ``points``: pairs within ``radius`` bits, as many as connect what ``links`` connects."""
    star, _, more = _met(points, radius, blocks)
    return star.select("u", "v").union(more.select("u", "v"))


def links(points: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(node, component) of the distinct ``fp`` of ``points``, for those that are not the least of their component.

    A component is what is reachable over links of at most ``radius`` differing
    bits. Spark splits cells whose rows outgrow a task (adaptive skew join).
    """
    _, found, more = _met(points, radius, blocks)
    return graphs.components(found.select(F.col("component").alias("u"), F.col("node").alias("v")).union(more.select("c", "d")))


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int = 3, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(_id, r1, r2, fp, group) of every row: rows of one ``group`` are near-duplicates."""
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    found = links(fps.select("fp").distinct(), radius, blocks)
    return fps.join(found, F.col("fp") == F.col("node"), "left").select("_id", "r1", "r2", "fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, blocks: int = BLOCKS,
) -> DataFrame:
    """Fingerprint and component of every row of ``docs``.

    Returns the id, ``fp`` (signed 64-bit) and ``component_id``, the smallest id
    reachable over links of at most ``radius`` differing bits, itself included;
    null ids are carried through and are the component only where no other is.
    Equal fingerprints link without a join; texts that are null, empty or
    without words have fingerprint zero and link like any other, very long
    texts are read whole. Empty tables give empty results, repeated rows are
    kept, other columns are not read, whatever their names.

    Copies are folded by a partial aggregate before anything is shuffled by
    fingerprint, so the range-join sees each distinct fingerprint once however
    many documents carry it. Handing the classes back to the documents are
    equi-joins whose hot fingerprints Spark splits (adaptive skew join).
    """
    rows = materialize(grouped(docs, id_col, text_col, words, radius, blocks), "grouped")
    least = materialize(rows.groupBy("group").agg(F.min("_id").alias("component_id")), "least")
    return rows.join(least, "group").select(F.col("_id").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates with all its columns, as ``one_of_each`` chooses it.

    Null and empty texts and those without words have fingerprint zero and are one group with whatever is near it; very long texts are read whole.
    """
    return one_of_each(docs, grouped(docs, id_col, text_col, **options), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``group`` of ``groups`` (_id, r1, r2, group): the one of the smallest id, nulls last, ties by the key.

    Null, empty and very long texts are rows like any other. Repeated rows count once. The keys that stay are hashed against the shuffled rows, so text is never sorted but for
    rows that repeat; columns of any names pass through. An empty table gives an empty result.
    """
    least = F.min(F.struct(F.isnull("_id").alias("null"), "_id", "r1", "r2"))
    first = groups.groupBy("group").agg(least.alias("k")).select("group", "k.r1", "k.r2")
    n = groups.join(first, ["group", "r1", "r2"]).groupBy("r1", "r2").agg(F.count("*").alias("n"))
    found = keyed.look_up(docs, n, keyed.key(id_col, text_col))
    many = found.where("n > 1").groupBy("r1", "r2").agg(F.first("row").alias("row"))
    return found.where("n = 1").select("row.*").union(many.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: components of all ``documents``."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
