"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by a hash of what they are into groups of bounded size;
each group is packed by one task, so bins compete within a group of about
``GROUP_ROWS`` pieces. A document longer than a bin is cut into pieces that
fill bins, and a rest. In descending order of size each piece goes into the
fullest bin that has room for it and does not conflict with it: bins are kept
by residual capacity, the search starts at the smallest residual that is large
enough and moves to the next successor until a bin is compatible.

A bin carries bitmaps of the sources that have no place left in it and of the
duplicate clusters in it. A cluster may be in a bin once; a source has no place
left once it has ``PER_SOURCE`` pieces in the bin and twice its share of the
words, so a source of half the words or more always has one. Bins of
one residual are kept apart by the sources and frequent clusters they are
closed to, so a search passes over all of them at once and steps only through
bins that hold one of the few copies of a rare cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from larkspan.functions.text import let
from larkspan.llm import rows as keyed
from larkspan.session import materialize, ship

CAPACITY = 2048
PER_SOURCE = 2
GROUP_ROWS = 16_384
#: Pieces of a cluster in a group from which the cluster is frequent.
FREQUENT = 32
WORD = "[^\\x20\\x09-\\x0D]+"


class Bins:
    """Open bins by residual capacity and by what they are closed to. ``limits``: words of each source after which it is closed out of a bin."""

    def __init__(self, capacity: int, limits: dict[int, float], per_source: int = PER_SOURCE) -> None:
        self.capacity, self.limits, self.per_source = capacity, limits, per_source
        self.by_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.occupied = 0  # bit r: some bin has residual r
        self.fill: list[int] = []
        self.closed: list[int] = []  # bitmaps of sources without a place and frequent clusters
        self.clusters: list[int] = []  # bitmaps of rare clusters
        self.counts: list[Counter] = []
        self.words: list[Counter] = []

    def find(self, size: int, closed: int, cluster: int) -> int | None:
        """The compatible bin of the least residual from ``size`` on, the oldest of equals."""
        rest = self.occupied >> size << size
        while rest:
            low = rest & -rest
            best = None
            for key, bins in self.by_residual[low.bit_length() - 1].items():
                if not key & closed:
                    first = next((b for b in bins if not self.clusters[b] & cluster), None)
                    best = first if best is None or first is not None and first < best else best
            if best is not None:
                return best
            rest ^= low
        return None

    def place(self, size: int, source: int, cluster: int = 0, frequent: int = 0) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin, or a new one; (bin, offset). Arguments but the size are bits."""
        b = self.find(size, source | frequent, cluster)
        if b is None:
            b = len(self.fill)
            self.fill.append(0)
            self.closed.append(0)
            self.clusters.append(0)
            self.counts.append(Counter())
            self.words.append(Counter())
        else:
            self._remove(b)
        start = self.fill[b]
        self.fill[b] += size
        self.clusters[b] |= cluster
        self.counts[b][source] += 1
        self.words[b][source] += size
        out = self.counts[b][source] >= self.per_source and self.words[b][source] >= self.limits[source]
        self.closed[b] |= frequent | (source if out else 0)
        r = self.capacity - self.fill[b]
        insort(self.by_residual[r].setdefault(self.closed[b], []), b)
        self.occupied |= 1 << r
        return b, start

    def _remove(self, b: int) -> None:
        r = self.capacity - self.fill[b]
        bins = self.by_residual[r][self.closed[b]]
        del bins[bisect_left(bins, b)]
        if not bins:
            del self.by_residual[r][self.closed[b]]
            if not self.by_residual[r]:
                self.occupied &= ~(1 << r)


def source_limits(sources: pd.Series, sizes: pd.Series, capacity: int) -> dict:
    """Twice each source's share of the words of a bin."""
    total = max(1, sizes.sum())
    return {s: 2 * n / total * capacity for s, n in sizes.groupby(sources).sum().items()}


def pack_group(pdf: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Pack the pieces of one group: adds ``bin`` and ``start``."""
    pdf = pdf.sort_values(["size", "r1", "r2", "nth", "piece"], ascending=[False, True, True, True, True], kind="stable")
    source = pd.Series(pd.factorize(pdf["source"].map(lambda s: "n" if pd.isna(s) else "v" + s))[0])
    limits = {1 << int(s): n for s, n in source_limits(source, pdf["size"].reset_index(drop=True), capacity).items()}
    cluster = pd.Series(pd.factorize(pdf["cluster"])[0])
    n = cluster.map(cluster.value_counts())
    frequent = pd.factorize(cluster.where(n >= FREQUENT))[0]  # -1 for the others
    rare = pd.factorize(cluster.where((n > 1) & (n < FREQUENT)))[0]  # a cluster that is here once needs no bit
    over = int(source.max()) + 1
    bins = Bins(capacity, limits, per_source)
    out = [
        bins.place(int(z), 1 << int(s), 1 << int(r) if r >= 0 else 0, 1 << over + int(f) if f >= 0 else 0)
        for z, s, r, f in zip(pdf["size"], source, rare, frequent, strict=True)
    ]
    pdf["bin"], pdf["start"] = [b for b, _ in out], [a for _, a in out]
    return pdf


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster, capacity: int, per_source: int, group_rows: int) -> DataFrame:
    """(r1, r2, _id, source, cluster, nth, piece, size, bin_id, start); r1 and r2 are the key of the id, source and text."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    default = F.md5(F.regexp_replace(F.lower(F.btrim(text)), "[\\x20\\x09-\\x0D]+", " "))
    rows = materialize(docs.select(
        *keyed.key(id_col, source_col, text_col), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
        (default if cluster is None else F.coalesce(cluster.cast("string"), default)).alias("cluster"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ), "sizes")
    groups = max(1, -(-rows.count() // group_rows))
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0))
    # repeated rows are folded and numbered, so that the same rows get the same places however they are read
    numbered = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pieces = (
        numbered.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("size", F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity)))
        .withColumn("group", F.pmod(F.xxhash64("r1", "r2", "nth", F.lit("pack")), F.lit(groups)).cast("int"))
        .drop("words", "n")
    )
    alone = F.concat(F.lit("d-"), F.hex("r1"), F.hex("r2"), F.lit("-"), "cluster", F.lit("-"), F.col("nth").cast("string"), F.lit("-"), F.col("piece").cast("string"))
    whole = pieces.where(F.col("size") == capacity).withColumns({"bin_id": alone, "start": F.lit(0).cast("long")})  # fills a bin by itself
    id_type = rows.schema["_id"].dataType.simpleString()
    packed = pieces.where(F.col("size") < capacity).groupBy("group").applyInPandas(
        lambda pdf: pack_group(pdf, capacity, per_source),
        f"r1 long, r2 long, _id {id_type}, source string, cluster string, nth long, piece long, size long, group int, bin long, start long",
    ).withColumn("bin_id", F.concat_ws("-", F.lit("g"), "group", "bin"))
    names = ["r1", "r2", "_id", "source", "cluster", "nth", "piece", "size", "bin_id", "start"]
    return packed.select(*names).union(whole.select(*names))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster=None,
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """A place for every row of ``docs``: (id, source, cluster, piece, size, bin_id, start).

    Size is counted in words (runs other than 0x20 and 0x09-0x0D). ``cluster``
    is a column of duplicate clusters, where it is null or not given the digest
    of the text in lower case with white space collapsed. A null or empty text
    has no words and takes a place of size 0; a very long one takes as many
    bins as it fills, and a rest; a null source is a source; null and repeated
    ids need no care; repeated rows belong to one cluster, so never share a
    bin. Ties of size go by the key of the row, so the same rows get the same
    bins on every run. An empty table gives an empty result; other columns are
    not read, whatever their names. A group has ``group_rows`` pieces in
    expectation, whatever the corpus holds, and a hot source or cluster is
    dealt over all groups. Sizes are written while the plan is built.
    """
    out = _placed(docs, id_col, text_col, source_col, cluster, capacity, per_source, group_rows)
    return out.select(F.col("_id").alias(id_col), "source", "cluster", "piece", "size", "bin_id", "start")


def pack_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster=None,
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """As ``pack``, with the text of each piece, so that the bins can be written out.

    A text that fits a bin is given unchanged (null as null); of a longer one
    each piece has its words joined by one space.
    """
    places = materialize(_placed(docs, id_col, text_col, source_col, cluster, capacity, per_source, group_rows), "places")
    text = F.col(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    last = F.greatest(F.ceil(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) / capacity) - 1, F.lit(0)).cast("int")
    cut = let(words, lambda w: F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * capacity + 1, F.lit(capacity)), " ")))
    texts = docs.select(*keyed.key(id_col, source_col, text_col), F.posexplode(F.when(last > 0, cut).otherwise(F.array(text))).alias("piece", "text"))
    texts = texts.groupBy("r1", "r2", F.col("piece").cast("long").alias("piece")).agg(F.first("text").alias("text"))
    out = texts.join(places.hint("shuffle_hash"), ["r1", "r2", "piece"])
    return out.select(F.col("_id").alias(id_col), "source", "cluster", "piece", "size", "bin_id", "start", F.col("text").alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: bins for all ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
