"""Quality rules and robust multivariate outliers.

Each document gets five integer statistics; a transformed vector of them is
held against the minimum-covariance-determinant (MCD) estimate of location and
scatter of its (language, source) group, and a document too far away by
Mahalanobis distance is rejected.

Spark reduces the vectors of a group to grid cells with exact moments: counts,
sums and cross products, integers throughout, so nothing depends on the
partitioning. The cells are as fine as keeps their number bounded; in a group
of few distinct vectors every vector is a cell. One task a group then searches
the half of least determinant: from several starts, concentration steps take
the cells nearest by the last estimate, the last of them in part, until the
determinant stops falling, and the least determinant wins.

The scatter is regularised in two ways, neither tuned to data. One count more
or less (a word, a character, a symbol, a repeated line, a repeated window) in
a text of the group's median size is never evidence, so its square is added to
the diagonal: many statistics are zero for most documents, and the half's own
variance is then zero. And a group's estimate is averaged with that of its
language, and a language's with that of the whole corpus, which weighs
``PRIOR`` documents; so a group of any size has an estimate, and the more of
its own the larger it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from larkspan.llm import kernel
from larkspan.session import materialize

U = np.uint64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
UNIT = 256
#: Documents that the estimate of the wider group weighs.
PRIOR = 10
#: Cells of a group, to the accuracy of an approximate count, and how often their sides can double.
CELLS, LEVELS = 16_384, 14
#: Random starts beside the two deterministic ones, concentration steps before the best are chosen, and how many are followed to the end.
STARTS, FIRST_STEPS, FOLLOWED, MOST_STEPS = 8, 2, 3, 100
#: 0.9999 quantile of chi-squared with five degrees of freedom.
CHI2_CUT = 25.745
#: What makes the scatter of the nearest half consistent at the normal distribution in five dimensions.
HALF_FACTOR = 1.913
#: Words, and characters a word, that a text is thought to go on for, so that the mean of a short text strays less.
SMOOTH_WORDS, USUAL_CHARS = 50, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(texts: kernel.Texts, rows: int, window: int = 8) -> dict:
    """The five base statistics of each text."""
    start, end, first = texts.words()
    n_words = np.diff(first)
    in_word = ~kernel.SEPARATOR[texts.buf]
    word_chars = texts.per_text(in_word & ((texts.buf & 0xC0) != 0x80))
    lstart, lend, lfirst = texts.lines()
    line_of = kernel.owner(lfirst)
    has_word = np.searchsorted(start, lend) > np.searchsorted(start, lstart)
    key = kernel.mix(texts.span_hash(lstart, lend) ^ kernel.mix(line_of.astype(U)))[has_word]
    distinct = np.bincount(line_of[has_word][np.unique(key, return_index=True)[1]], minlength=rows)
    n_dup = np.bincount(line_of[has_word], minlength=rows) - distinct
    n_repeat = np.zeros(rows, np.int64)
    if len(start) >= window:
        doc = kernel.owner(first)
        h = kernel.windows(texts.span_hash(start, end), window)
        inside = doc[: len(h)] == doc[window - 1 :]
        at = np.flatnonzero(inside)
        k = kernel.mix(h[at] ^ kernel.mix(doc[at].astype(U)))
        order = np.argsort(k)
        same = k[order][1:] == k[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.subtract.at(edge, at[twice] + window, 1)
        n_repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=rows)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": texts.per_text(_SYMBOL[texts.buf]),
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
    }


def _transformed() -> list:
    """The statistics as roughly symmetric values, in units of 1/UNIT."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    mean = (F.col("word_chars") + SMOOTH_WORDS * USUAL_CHARS) / (F.col("n_words") + SMOOTH_WORDS)
    values = (
        F.log1p(F.col("n_words")),
        F.log(mean),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.sqrt(10 * F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return [F.round(v * UNIT).cast("long").alias(f"_x{i}") for i, v in enumerate(values)]


def grain(words: float, chars_a_word: float) -> np.ndarray:
    """What one count more does to each transformed statistic of a text of ``words`` words."""
    chars = max(1.0, words * chars_a_word)
    words = max(1.0, words)
    return np.array([1 / words, 1 / chars, np.log1p(1000 / chars), np.sqrt(10 / words), np.sqrt(8 / words)])


class Cells:
    """The cells of one group: number of rows, mean, and scatter of the rows around the mean; in units of one."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> None:
        self.n, self.mean, self.scatter = n.astype(float), mean, scatter
        self.total = float(self.n.sum())
        self.half = float((int(self.total) + DIM + 1) // 2) if self.total > DIM else self.total

    def moments(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of ``share`` rows of each cell."""
        w = share.sum()
        m = share @ self.mean / w
        d = self.mean - m
        return m, ((d * share[:, None]).T @ d + np.tensordot(share / self.n, self.scatter, 1)) / w

    def nearest(self, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """How many rows of each cell the half nearest to ``centre`` takes; ties go to the first cell."""
        d = self.mean - centre
        order = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")
        share = np.zeros(len(order))
        share[order] = np.clip(self.half - np.concatenate([[0.0], np.cumsum(self.n[order])[:-1]]), 0, self.n[order])
        return share

    def median(self, axis: int) -> float:
        order = np.argsort(self.mean[:, axis], kind="stable")
        return float(self.mean[order[np.searchsorted(np.cumsum(self.n[order]), self.total / 2)], axis])


def mcd(cells: Cells, pool: tuple | None = None, starts: int = STARTS, steps: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(centre, scatter, log determinant, rows taken of each cell) of the half of least determinant that was found.

    ``pool`` is (centre, scatter) of a wider group. ``steps`` bounds the concentration steps; 0 leaves the first start as it is.
    """
    median = np.array([cells.median(i) for i in range(DIM)])
    noise = np.diag(grain(np.expm1(median[0]), np.exp(median[1])) ** 2)
    weight = PRIOR if pool else 0
    own = cells.half / (cells.half + weight)

    def fit(share):
        m, s = cells.moments(share)
        cov = own * HALF_FACTOR * s + (1 - own) * (pool[1] if pool else 0) + noise
        return m, cov, float(np.linalg.slogdet(cov)[1])

    def follow(m, cov, most):
        share, least = None, np.inf
        for _ in range(most):
            taken = cells.nearest(m, cov)
            m, cov, det = fit(taken)
            if det >= least - 1e-9:
                break
            share, least = taken, det
        return share, least

    whole = cells.moments(cells.n)[1]
    first = (median, np.diag(np.diag(whole)) + noise)
    begin = [first, (median, whole + noise)]
    rng = np.random.default_rng(len(cells.n))
    if len(cells.n) > DIM + 1:
        for _ in range(starts):
            m = cells.mean[rng.choice(len(cells.n), DIM + 1, replace=False, p=cells.n / cells.total)]
            begin.append((m.mean(0), np.cov(m.T, bias=True) + noise))
    if steps:
        tried = sorted((follow(m, c, min(steps, FIRST_STEPS)) for m, c in begin), key=lambda t: t[1])[:FOLLOWED]
        share = min((follow(*fit(t[0])[:2], steps) for t in tried), key=lambda t: t[1])[0]
    else:
        share = cells.nearest(*first)
    m, cov, det = fit(share)
    if pool:
        m = own * m + (1 - own) * pool[0]
    return m, cov, det, share


_UPPER = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_PARAMS = ["_k1 string", "_k2 string", *(f"_m{i} double" for i in range(DIM)), *(f"_s{i}{j} double" for i, j in _UPPER), *(f"_a{i}{j} double" for i, j in _UPPER)]
_NAMES = [p.split()[0] for p in _PARAMS]


def _square(values) -> np.ndarray:
    out = np.zeros((DIM, DIM))
    for (i, j), v in zip(_UPPER, values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _cells(x: DataFrame) -> DataFrame:
    """Cells of every group (_k1, _k2) of ``x``: corner, side, count, sums and cross products of the rows' offsets."""
    sketches = [F.approx_count_distinct(F.xxhash64(*[F.shiftright(f"_x{i}", k) for i in range(DIM)])).alias(f"_n{k}") for k in range(LEVELS)]
    level = F.coalesce(*[F.when(F.col(f"_n{k}") <= CELLS, k) for k in range(LEVELS)], F.lit(LEVELS))
    levels = x.groupBy("_k1", "_k2").agg(*sketches).select("_k1", "_k2", level.alias("_level"))
    put = x.join(levels, ["_k1", "_k2"]).selectExpr("_k1", "_k2", "_level", *[f"shiftright(_x{i}, _level) AS _c{i}" for i in range(DIM)], *[f"_x{i}" for i in range(DIM)])
    put = put.selectExpr("*", *[f"_x{i} - shiftleft(_c{i}, _level) AS _o{i}" for i in range(DIM)])
    return put.groupBy("_k1", "_k2", "_level", *[f"_c{i}" for i in range(DIM)]).agg(
        F.count("*").alias("_n"), *[F.sum(f"_o{i}").alias(f"_t{i}") for i in range(DIM)],
        *[F.sum(F.col(f"_o{i}") * F.col(f"_o{j}")).alias(f"_p{i}{j}") for i, j in _UPPER],
    )


def _fit_group(pdf: pd.DataFrame, starts: int, steps: int) -> pd.DataFrame:
    """The parameters of one group from its cells, which carry those of the wider group in _m*, _s* (null for none)."""
    pdf = pdf.sort_values([f"_c{i}" for i in range(DIM)], kind="stable")
    n = pdf["_n"].to_numpy(float)
    sums = pdf[[f"_t{i}" for i in range(DIM)]].to_numpy(float)
    side = 2.0 ** pdf["_level"].to_numpy()[:, None]
    mean = (pdf[[f"_c{i}" for i in range(DIM)]].to_numpy(float) * side + sums / n[:, None]) / UNIT
    cross = np.stack([_square(r) for r in pdf[[f"_p{i}{j}" for i, j in _UPPER]].to_numpy(float)])
    scatter = (cross - sums[:, :, None] * sums[:, None, :] / n[:, None, None]) / UNIT**2
    first = pdf.iloc[0]
    pool = None
    if not np.isnan(first["_m0"]):
        pool = first[[f"_m{i}" for i in range(DIM)]].to_numpy(float), _square(first[[f"_s{i}{j}" for i, j in _UPPER]].to_numpy(float))
    m, cov, _, _ = mcd(Cells(n, mean, scatter), pool, starts, steps)
    a = np.linalg.inv(cov)
    row = [first["_k1"], first["_k2"], *m, *(cov[i, j] for i, j in _UPPER), *(a[i, j] for i, j in _UPPER)]
    return pd.DataFrame([row], columns=_NAMES)


def _fit(x: DataFrame, k1, k2, wider, pool: DataFrame | None, starts: int, steps: int) -> DataFrame:
    """Parameters of the groups that the columns ``k1`` and ``k2`` make.

    ``pool`` holds those of the wider groups; ``wider`` of ``_k1`` names a group's.
    """
    cells = _cells(x.select(k1.alias("_k1"), k2.alias("_k2"), *[f"_x{i}" for i in range(DIM)]))
    names = [n for n in _NAMES if n[1] in "ms"]
    if pool is None:
        cells = cells.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    else:
        wide = pool.select(F.col("_k1").alias("_w"), *names)
        cells = cells.join(wide, wider == F.col("_w"), "left").drop("_w")
    return materialize(cells.groupBy("_k1", "_k2").applyInPandas(lambda pdf: _fit_group(pdf, starts, steps), ", ".join(_PARAMS)), "mcd")


def _distance():
    """Squared Mahalanobis distance by the columns _m0.. (centre) and _a00.. (upper triangle of the precision)."""
    d = [F.col(f"_x{i}") / UNIT - F.col(f"_m{i}") for i in range(DIM)]
    out = None
    for i, j in _UPPER:
        t = d[i] * d[j] * F.col(f"_a{i}{j}") * (1 if i == j else 2)
        out = t if out is None else out + t
    return out


def _key(name: str):
    """A group's key: a null is a group of its own."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(name)))


def robust_outliers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_words: int = 20, repeat_percent: int = 30, cut: float = CHI2_CUT, starts: int = STARTS, steps: int = MOST_STEPS,
) -> DataFrame:
    """Base statistics, base rules and the MCD verdict for every row of ``docs``.

    Returns the id, the five statistics, ``base_failed``, ``kept`` and
    ``distance`` (squared Mahalanobis distance to the row's own language and
    source, null where no document of that group passes the base rules). The
    estimates are of the documents that pass the base rules. A null text has
    no words, so it fails them; so does an empty one. A very long text is one
    row like any other. A null language or source is a group of its own; a
    group of one document has an estimate, near its language's. Documents of
    equal statistics get equal verdicts; repeated rows count as often as they
    occur, null and repeated ids are carried through. An empty table gives an
    empty result; other columns are not read, whatever their names.

    The statistics are written to the scratch folder while the plan is built,
    and the estimates are fitted then. A group reaches its task as at most
    about ``CELLS`` cells, whatever its size.
    """
    src = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
        F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"),
    )
    id_type = src.schema["_id"].dataType.simpleString()
    stats = materialize(kernel.map_texts(
        src, ["_id", "_lang", "_source"], "_text", statistics,
        f"_id {id_type}, _lang string, _source string, " + ", ".join(f"{c} long" for c in BASE),
    ), "stats")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    named = stats.select("*", _key("_lang").alias("_l"), _key("_source").alias("_s"), failed.alias("base_failed"), *_transformed())
    x, every = named.where("NOT base_failed"), F.lit("all")
    corpus = _fit(x, every, every, None, None, starts, steps)
    languages = _fit(x, F.col("_l"), every, every, corpus, starts, steps)
    groups = _fit(x, F.col("_l"), F.col("_s"), F.col("_k1"), languages, starts, steps)
    params = groups.select(F.col("_k1").alias("_l"), F.col("_k2").alias("_s"), *[n for n in _NAMES if n[1] in "ma"])
    return (
        named.join(params, ["_l", "_s"], "left").withColumn("distance", F.round(_distance(), 6))
        .select(
            F.col("_id").alias(id_col), *BASE, "base_failed",
            (~F.col("base_failed") & (F.col("distance") <= cut)).alias("kept"), "distance",
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: base statistics and MCD verdict of all ``documents``."""
    return robust_outliers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
