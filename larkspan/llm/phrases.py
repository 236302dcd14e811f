"""Collocations: frequent phrases whose parts belong together.

The first pass counts the n-grams of each language in count-min sketches, first
those of one and two words, then those of three and four whose pairs of words
pass the first sketch. A task's sketch is sparse, blocks of cells and their
counts; the blocks of all tasks are merged by a shuffle, and what remains of a
cell is whether it reaches ``MIN_COUNT``. A cell counts all n-grams that hash to
it, so an n-gram below ``MIN_COUNT`` may pass and one at ``MIN_COUNT`` or above
always does. The second pass reads the texts again and counts exactly those
n-grams that pass in every row of the sketches, and whose parts do; each task
counts its own with exact dictionaries of words and of their sequences, and
Spark sums them by the phrase itself.

A sketch grows with the text up to ``MOST_CELLS`` a row, 64 MB of bits. Beyond
that more n-grams pass, so the second pass counts more of them; none is lost
and none is miscounted.

Scores come from the frequent phrases alone: a part of a frequent phrase is at
least as frequent. They are compared in decimals, so no product overflows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspan.llm import kernel
from larkspan.session import materialize, ship

UNKNOWN = "und"
LONGEST, MIN_COUNT, MOST, COVER = 4, 30, 2000, 80
ROWS = 2
#: Words of the n-grams that are counted together, in this order.
LEVELS = ((1, 2), (3, 4))
#: Least and most cells of a row of the sketch, and bytes of text for which there is one.
LEAST_CELLS, MOST_CELLS, BYTES_A_CELL = 1 << 22, 1 << 29, 16
#: Cells of a block; entries of a task's sketch that are held before they are sent.
BLOCK, HELD = 1 << 16, 1 << 22
#: Bytes of text handled at once; a longer text is cut.
CHUNK = 1 << 21
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
_M = np.uint64(0xD1B54A32D192ED03)


def segments(buf: np.ndarray, limit: int, longest: int = LONGEST) -> Iterator[tuple[int, int, int]]:
    """(start, end, context) of pieces of about ``limit`` bytes of one long text.

    A cut falls on a break, where no phrase goes on, or else on a space; the next piece then begins with the ``context``
    last words of the one before, and phrases that end within them have been counted.
    """
    start, context, n = 0, 0, len(buf)
    fresh = 0  # where text not yet counted begins
    while True:
        if n - fresh <= limit:
            yield start, n, context
            return
        at = np.flatnonzero(BREAK[buf[fresh : fresh + limit]])
        if len(at):
            end, after, context_next = fresh + int(at[-1]) + 1, None, 0
        else:
            at = np.flatnonzero(SPACE[buf[fresh : fresh + limit]])
            if len(at):
                end = fresh + int(at[-1]) + 1
            else:  # one word longer than the limit
                rest = np.flatnonzero((SPACE | BREAK)[buf[fresh + limit :]])
                end = fresh + limit + int(rest[0]) + 1 if len(rest) else n
            after = kernel.Texts(buf[start:end], np.array([0, end - start])).runs(~(SPACE | BREAK)[buf[start:end]])[0]
            context_next = min(longest - 1, len(after))
        yield start, end, context
        if end >= n:
            return
        fresh, context = end, context_next
        start = end if not context else start + int(after[-context])


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, kernel.Texts, int]]:
    """(first row, end row, texts, context words) of pieces of bounded size of a column of texts."""
    for i, j, texts in kernel.chunks(column, limit):
        if len(texts.buf) <= 2 * limit:
            yield i, j, texts, 0
            continue
        for a, b, context in segments(texts.buf, limit):
            yield i, j, kernel.Texts(texts.buf[a:b], np.array([0, b - a])), context


class Grams:
    """The words of some texts and the hashes of their n-grams.

    ``hashes[n - 1][i]`` belongs to the n words from word i on, and ``whole[n - 1][i]`` says whether they lie in one
    piece and end behind the context.
    """

    def __init__(self, texts: kernel.Texts, seeds: np.ndarray, context: int = 0, longest: int = LONGEST) -> None:
        self.texts = kernel.Texts(kernel.LOWER[texts.buf], texts.at)
        broken = BREAK[texts.buf]
        self.start, self.end = texts.runs(~(broken | SPACE[texts.buf]))
        self.doc = np.searchsorted(texts.at, self.start, side="right") - 1
        # empty texts share a boundary with the next: a word belongs to the last text that starts at or before it
        piece = np.concatenate([[0], np.cumsum(broken)])[self.start] + self.doc
        h = self.texts.span_hash(self.start, self.end)
        n = len(h)
        g = kernel.mix(h ^ seeds[self.doc]) if n else h
        self.hashes, self.whole = [g], [np.arange(n) >= context]
        for k in range(1, longest):
            m = max(0, n - k)
            g = kernel.mix(g[:m] * _M + h[k : k + m])
            self.hashes.append(g)
            self.whole.append((piece[:m] == piece[k : k + m]) & (np.arange(m) + k >= context))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in one row of the sketch, rows one after the other; all rows together have less than 2**32."""
    h = hashes if not row else kernel.mix(hashes + np.uint64(row))
    return (h & np.uint64(width - 1)).astype(np.uint32) + np.uint32(row * width)


def _summed(at: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their counts, up to ``MIN_COUNT``."""
    if not len(at):
        return at, np.zeros(0, np.uint8)
    if n is None:
        at = np.sort(at)
    else:  # cell and count in one number, so that sorting moves both
        both = np.sort(at.astype(np.uint64) << np.uint64(8) | n)
        at, n = (both >> np.uint64(8)).astype(np.uint32), (both & np.uint64(255)).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at))) if n is None else np.add.reduceat(n, first)
    return at[first], np.minimum(count, MIN_COUNT).astype(np.uint8)


def _pack(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(block, cells): each block's cells as differences, low bytes before high bytes, then their counts, compressed."""
    block = (at // BLOCK).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(at) else []
    zip_ = zstandard.ZstdCompressor(level=1).compress
    low = (at % BLOCK).astype(np.uint16)
    step = low.copy()
    step[1:] -= low[:-1]
    step[cut[:-1]] = low[cut[:-1]]
    data = [zip_(step[i:j].view(np.uint8).reshape(-1, 2).T.tobytes() + n[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array(data, pa.binary())], names=["block", "cells"])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 3
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * n).reshape(2, n).T).view(np.uint16).ravel()
    return np.cumsum(step, dtype=np.uint16), np.frombuffer(raw, np.uint8, n, 2 * n)


def sketch(docs: DataFrame, width: int, level: int, before: list[np.ndarray]) -> DataFrame:
    """(block, bits): of each block of cells that some n-gram of ``docs`` (lang, seed, text) falls into, which cells reach ``MIN_COUNT``.

    Counts the n-grams of a level whose parts pass in the sketches of the levels before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(before)  # ROWS * MOST_CELLS bits a level

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for i, j, texts, context in chunks(b.column(2), CHUNK):
                g = Grams(texts, b.column(1).slice(i, j - i).to_numpy().view(np.uint64), context, LEVELS[level][-1])
                live = alive(g, shared.value, width, level)
                held.append(_summed(np.concatenate([cells(g.hashes[k - 1][live[k - 1] & g.whole[k - 1]], r, width) for k in LEVELS[level] for r in range(ROWS)])))
                del g, live
                size += len(held[-1][0])
                if size >= HELD:
                    held = [_summed(np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held]))]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield _pack(*held[0])
                        held, size = [], 0
        if held:
            yield _pack(*_summed(np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held])))

    def merge(batches):
        block, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(total >= MIN_COUNT, bitorder="little").tobytes()])], names=["block", "bits"])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, total = k, np.zeros(BLOCK, np.uint32)
                at, n = _unpack(data.as_py())
                total[at] += n
        if block is not None:
            yield done()

    parts = docs.select("lang", "seed", "text").mapInArrow(count, "block long, cells binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # blocks of one partition stream past in order, so a task holds one of them
    return parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")


def passing(hashes: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Whether each hash's cells all reach ``MIN_COUNT``."""
    out = np.ones(len(hashes), bool)
    for r in range(ROWS):
        at = cells(hashes[out], r, width)
        out[out] = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def alive(g: Grams, sketches: list[np.ndarray], width: int, most: int) -> list[np.ndarray]:
    """For each number of words, which n-grams may be frequent: they and their parts pass in the sketches of the levels below ``most``."""
    out: list[np.ndarray] = []
    for level, lengths in enumerate(LEVELS[: most + 1]):
        for k in lengths:
            may = np.ones(len(g.hashes[0]), bool) if k == 1 else out[-1][: len(g.hashes[k - 1])] & out[-1][1 : len(g.hashes[k - 1]) + 1]
            if level < most:
                at = np.flatnonzero(may)
                may = np.zeros(len(may), bool)
                may[at[passing(g.hashes[k - 1][at], sketches[level], width)]] = True
            out.append(may)
    return out


def _codes(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values as equal numbers from 0 on, and how many there are."""
    d = pa.array(values).dictionary_encode()
    return d.indices.to_numpy(), len(d.dictionary)


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``buf`` as strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def count_passing(g: Grams, lang: pa.Array, sketches: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """(lang, k, phrase, n): exact counts of the n-grams of ``g`` that pass in the sketches, with all their parts; k = 0 counts all words."""
    lang = lang.dictionary_encode()
    of = lang.indices.to_numpy()[g.doc]
    names = lang.dictionary

    def rows(which: np.ndarray, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        columns = [names.take(pa.array(which)), pa.array(np.full(len(n), k, np.int32)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "n"])

    total = np.bincount(of[g.whole[0]], minlength=len(names))
    yield rows(np.arange(len(names)), 0, pa.array([""] * len(names), pa.large_string()), total)
    # an n-gram's parts pass wherever it is frequent; context words take part in phrases that end behind them
    lives = alive(g, sketches, width, len(LEVELS))
    at = np.flatnonzero(lives[0])
    if not len(at):
        return
    words = _strings(g.texts.buf, g.start[at], g.end[at]).dictionary_encode()
    word = np.zeros(len(lives[0]), np.int64)
    word[at] = words.indices.to_numpy()
    code, parts = of.astype(np.int64) << 32 | word, [word]
    for k in range(1, LONGEST + 1):
        live = lives[k - 1]
        at = np.flatnonzero(live)
        if not len(at):
            return
        if k > 1:
            parts.append(word[k - 1 :])
            code = code[: len(live)] << 32 | parts[-1]
        number, n = _codes(code[at])
        code = np.zeros(len(live), np.int64)
        code[at] = number
        counted = g.whole[k - 1][at]
        count = np.bincount(number[counted], minlength=n)
        some = np.zeros(n, np.int64)
        some[number] = at
        have = np.flatnonzero(count)
        some = some[have]
        phrase = words.dictionary.take(pa.array(parts[0][some]))
        for part in parts[1:]:
            phrase = pc.binary_join_element_wise(phrase, words.dictionary.take(pa.array(part[some])), pa.scalar(" ", pa.large_string()))
        yield rows(of[some], k, phrase, count[have])


def _words(phrase: str) -> Column:
    """The number of words of a phrase."""
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k, phrase, f) of all phrases of ``k`` = 1 to ``LONGEST`` words that occur ``MIN_COUNT`` times or more; k = 0 has the number of words."""
    spark = docs.sparkSession
    ship(spark)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    src = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.col(f"`{text_col}`").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = LEAST_CELLS
    while width < MOST_CELLS and width * BYTES_A_CELL < size:
        width *= 2
    sketches: list[np.ndarray] = []
    for level in range(len(LEVELS)):
        whole = np.zeros(ROWS * width // 8, np.uint8)
        for b in sketch(src, width, level, list(sketches)).toArrow().to_batches():  # at most ROWS * MOST_CELLS bits
            for block, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits.as_py(), np.uint8)
        sketches.append(whole)
    shared = spark.sparkContext.broadcast(sketches)

    def count(batches):
        for b in batches:
            for i, j, texts, context in chunks(b.column(2), CHUNK):
                g = Grams(texts, b.column(1).slice(i, j - i).to_numpy().view(np.uint64), context)
                yield from count_passing(g, b.column(0).slice(i, j - i), shared.value, width)

    parts = src.mapInArrow(count, "lang string, k int, phrase string, n long")
    # one string and one number a row are shuffled; a phrase holds no line break, so the first one ends it
    f = parts.groupBy(F.concat("phrase", F.lit("\n"), "lang").alias("key")).agg(F.sum("n").alias("f"))
    f = f.select(F.substring_index("key", "\n", 1).alias("phrase"), F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), "f")
    f = f.select("lang", F.when(F.col("phrase") == "", 0).otherwise(_words("phrase")).alias("k"), "phrase", "f")
    return materialize(f.where(f"k = 0 OR f >= {MIN_COUNT}"), "frequent")


def _exact(c: Column | str) -> Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def score(a: str, whole: Column) -> Column:
    """floor(2000000 a / whole), exactly."""
    product = _exact(a) * F.lit(2000000).cast("decimal(7,0)")
    return ((product - product % whole) / whole).cast("long")  # the division leaves no remainder


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of every language.

    Texts, A-Z in lower case, are cut into pieces at ``. , ; : ! ?`` and 0x0A to
    0x0D, pieces into words at spaces and tabs. Phrases of two to four words that
    occur ``a`` >= 30 times within pieces are candidates, overlapping occurrences
    included. A cut behind the k-th word gives ``l`` and ``r``, the occurrences of
    both parts, and floor(2000000 a / (l + r)); the lowest counts, ties to the
    smallest k. Candidates inside a longer candidate with at least 80 % of their
    occurrences are dropped. Order: score and a, descending, then the phrase by
    its bytes. ``n`` is the number of words of the language.

    A null language is ``und``, a null or empty text has no words, a very long
    text is read piece by piece, repeated rows count each. An empty table gives
    an empty result; other columns are not read, whatever their names.
    """
    f = frequent(docs, text_col, lang_col)
    words = f.where("k = 0").select("lang", F.col("f").alias("n"))
    c = f.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cut = c.select("lang", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    # both parts spell the phrase, and the first has as many words as the cut, so neither is shuffled beside them
    cut = cut.select("lang", "a", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = f.where(F.col("k").between(1, LONGEST - 1))
    both = cut.join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.withColumns({"phrase": F.concat_ws(" ", "first", "rest"), "cut": _words("first")})
    both = both.withColumn("score", score("a", _exact("l") + _exact("r")))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # every contiguous part of two words or more of a longer candidate
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.struct(i.alias("i"), n.alias("n"))))),
        lambda x: x["i"] + x["n"] - 1 <= F.col("k"),
    )
    held = c.where("k > 2").select("lang", "a", F.explode(F.transform(inner, lambda x: part(x["i"], x["n"]))).alias("phrase"))
    cover = held.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    left = scored.join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (_exact("cover") * 100 < _exact("a") * COVER))
    rows = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first among the phrases of one lane, then among the firsts of all lanes
    lane = rows.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = lane.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: collocations of all ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, row, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT *, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)
), w AS (
  SELECT lang, row, i, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)
), g AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY row, i ORDER BY pos)
), f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cut AS (
  SELECT lang, phrase, a, x, array_to_string(ws[:x], ' ') AS first, array_to_string(ws[x + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS x FROM c)
), s AS (
  SELECT cut.lang, cut.phrase, a, x, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = first JOIN f r ON r.lang = cut.lang AND r.phrase = rest
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
part AS (
  SELECT lang, a, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(2, k)) AS n FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k > 2)) WHERE i + n - 1 <= k
), cover AS (SELECT lang, phrase, max(a) AS cover FROM part GROUP BY ALL),
left_ AS (
  SELECT best.* FROM best LEFT JOIN cover USING (lang, phrase) WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
), n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM left_ JOIN n USING (lang) QUALIFY rank <= 2000
"""
