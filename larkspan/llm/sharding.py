"""Minimax contiguous partition of a corpus into shards.

Equal texts form an atomic group. Groups are ordered by a 62-bit hash of the
text; the capacity of the fullest shard is minimised over all contiguous
partitions of the ordered groups: binary search for the smallest capacity for
which the greedy filling needs no more than ``shards`` shards, and the shards
are cut where that filling cuts.

The driver never holds the groups. It starts from the sums of ``RANGES`` equal
ranges of the hash and splits those that matter: a search in which a range
cannot be cut gives an upper bound of the capacity, one in which it can be cut
anywhere a lower bound, and the ranges in which a cut can fall between the two
are split in ``SPLIT`` by another pass over narrow rows, until each is one group
or the bounds meet. So the capacity is the smallest over the groups
themselves, after a number of passes logarithmic in their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window

from larkspan.session import materialize

BITS = 62
RANGES_BITS, SPLIT_BITS = 12, 6
LANES = 16


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which greedy filling of ``sizes``, in order, needs at most ``shards`` shards."""

    def feasible(cap: int) -> bool:
        used, room = 1, cap
        for s in sizes:
            if s > room:
                used, room = used + 1, cap
                if used > shards:
                    return False
            room -= s
        return True

    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def greedy_cut(sizes: list[int], cap: int) -> list[int]:
    """The shard of each size under greedy filling to ``cap``."""
    out, shard, room = [], 0, cap
    for s in sizes:
        if s > room:
            shard, room = shard + 1, cap
        room -= s
        out.append(shard)
    return out


@dataclass(frozen=True)
class Range:
    """Hashes from ``low`` on for ``1 << bits``; ``one`` if they hold a single group."""

    low: int
    bits: int
    size: int
    one: bool


def fluid_capacity(ranges: list[Range], shards: int) -> int:
    """A capacity that no contiguous partition of the groups can beat: ranges of several groups are cut anywhere."""
    def feasible(cap: int) -> bool:
        used, room = 1, cap
        for r in ranges:
            if r.one:
                if r.size > room:
                    used, room = used + 1, cap
                room -= r.size
            else:
                more = max(0, -(-(r.size - room) // cap)) if cap else shards
                used, room = used + more, room + more * cap - r.size
            if used > shards:
                return False
        return True

    low, high = max([r.size for r in ranges if r.one], default=0), sum(r.size for r in ranges)
    low = max(low, -(-high // shards))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def open_ranges(ranges: list[Range], shards: int, least: int, most: int) -> list[Range]:
    """The ranges of several groups in which a cut may fall for a capacity from ``least`` to ``most``."""
    near, used, room, at = [], 0, least, 0
    for r in ranges:  # the earliest cuts: the least capacity, nothing split
        if r.size > room:
            near.append(at)
            used, room = used + 1, max(least, r.size)
        room -= r.size
        at += r.size
    near = (near + [at] * shards)[: shards - 1]
    far = [(i + 1) * most for i in range(shards - 1)]  # the latest: the greatest capacity, everything split
    out, at = [], 0
    for r in ranges:
        if not r.one and (r.size > least or any(at <= f and at + r.size >= n for n, f in zip(near, far, strict=True))):
            out.append(r)
        at += r.size
    return out


def _sums(rows: DataFrame, split: list[Range], by: int) -> list[Range]:
    """The parts of the ranges ``split``, each cut in ``1 << by`` (fewer where it has fewer hashes), that hold anything."""
    which = F.coalesce(*[F.when((F.col("_h") >= r.low) & (F.col("_h") < r.low + (1 << r.bits)), F.lit(k)) for k, r in enumerate(split)])
    shift = F.array(*[F.lit(max(0, r.bits - by)) for r in split])
    part = F.expr("shiftright(_h, _shift)")
    found = (
        rows.withColumn("_of", which).where("_of IS NOT NULL").withColumn("_shift", F.get(shift, "_of"))
        .groupBy("_of", part.alias("_part")).agg(F.sum("size").alias("b"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).collect()
    )
    out = []
    for r in found:
        bits = max(0, split[r["_of"]].bits - by)
        out.append(Range(r["_part"] << bits, bits, r["b"], r["lo"] == r["hi"]))
    return out


def cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hashes at which the shards after the first begin, and the capacity, for ``rows`` (_h, size)."""
    ranges = sorted(_sums(rows, [Range(0, BITS, 0, False)], RANGES_BITS), key=lambda r: r.low)
    while True:
        sizes = [r.size for r in ranges]
        most = smallest_capacity(sizes, shards)
        least = fluid_capacity(ranges, shards)
        todo = open_ranges(ranges, shards, least, most) if least < most else []
        if not todo:
            shard = greedy_cut(sizes, most)
            return [r.low for k, r in enumerate(ranges) if k and shard[k] != shard[k - 1]], most
        ranges = sorted([r for r in ranges if r not in set(todo)] + _sums(rows, todo, SPLIT_BITS), key=lambda r: r.low)


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, lanes: int = LANES,
) -> DataFrame:
    """Deal ``docs`` into ``shards`` shards of near equal bytes, equal texts together.

    Returns id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and
    ``slot``, the gapless position within the shard. A null or empty text
    counts as no bytes and groups with the others; a very long text is one
    group that is never cut; an empty table gives an empty result; repeated
    rows are separate rows of one group; null and repeated ids are carried
    through. Slots of one group go by lane, then by id. Other columns of
    ``docs`` are not read, whatever their names.

    Only (id, size, crc32, hash) is written and shuffled, never the text. A hot
    group is dealt over ``lanes`` lanes, each numbered by its own task. The
    capacity is found while the plan is built.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(body), 64 - BITS).alias("_h"),
    ), "hashes")
    begins, _ = cuts(rows, shards)
    shard = sum((F.when(F.col("_h") >= b, 1).otherwise(0) for b in begins), F.lit(0))
    rows = rows.withColumns({
        "shard": shard.cast("int"), "_range": F.shiftright("_h", BITS - RANGES_BITS).cast("int"),
        "_lane": F.pmod(F.xxhash64("_id"), F.lit(lanes)).cast("int"),
    })
    cell = ["shard", "_range", "_lane"]
    before = Window.partitionBy("shard").orderBy("_range", "_lane").rowsBetween(Window.unboundedPreceding, -1)
    plan = rows.groupBy(*cell).agg(F.count("*").alias("_c")).select(*cell, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*cell).orderBy("_h", "_id", "text_crc32", "size")
    return (
        rows.withColumn("_n", F.row_number().over(w)).join(plan, cell)
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all ``documents`` over shards 0 to 7 by law ``bytes``."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
