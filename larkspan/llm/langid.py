"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A document is
parsed greedily against it: the longest match from here is one phrase, the next
phrase starts behind it. A text in the automaton's language needs few long
phrases. The number of phrases, times the logarithm of the length of the
reference, divided by the length of the document, estimates the cross entropy;
the language that needs least wins.

Whole texts of the sampled documents make the automata, over all their letters.
An automaton has at most three transitions a symbol, so those of all languages
are interleaved in one array (a state is an offset at which its transitions fit
between those of others), and thousands of lanes of documents advance through
all languages together, a few numpy operations a symbol.

A lane is at most ``SEGMENT`` symbols. A longer document is parsed as several
lanes that all start a phrase; then the true parse of the lane before is
carried into each lane until both are in one state, from where they are the
same. So every text has the phrases of one
greedy parse from its first symbol to its last. A text of more than ``CHUNK``
symbols times languages is parsed block by block, each from the state that the
one before ended in.

Whether a language can be told at all is read from the phrases too. Beside its
automaton each language learns how many phrases a symbol it takes, in labelled
documents that the automaton has not seen, and how many random letters of the
language take; half-way is the limit. A text is judged by parts of ``PART``
symbols, each by the language that it is cheapest in for that language's limit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larkspan.llm import kernel
from larkspan.session import ship

UNDETERMINED = "und"
#: Labelled documents that teach one language; they are learned whole.
SAMPLE_DOCS = 12
#: Characters that teach one language: documents are left out beyond, and one that is longer by itself is cut.
SAMPLE_CHARS = 1 << 20
#: Further documents of each language that show what its text costs, and symbols of random letters that show what noise costs.
SEEN_DOCS, NOISE = 6, 20_000
#: Symbols of a text that are judged together.
PART = 64
SEGMENT = 1024
#: Symbols times languages parsed at once.
CHUNK = 1 << 23
_NEXT = 32


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``text``; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


def letters(text: str) -> list[int]:
    """The symbols of reference text: letters in lower case by code point, and 0 for a run of anything else."""
    out = [0]
    for ch in text:
        if ch.isalpha():
            low = ch.lower()
            out.append(ord(low) if len(low) == 1 else ord(ch))
        elif out[-1]:
            out.append(0)
    return out


def interleave(state: np.ndarray, symbol: np.ndarray, to: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The offset of every state, and the array that holds the transitions: state ``b``'s by symbol ``c`` at ``b + c``, marked as its own.

    States of many transitions are placed first. In each round all that are
    left draw an offset, and those whose places are free and not claimed by
    another are placed; half of the array stays empty, so few rounds do.
    """
    order = np.lexsort((symbol, state))
    state, symbol, to = state[order], symbol[order], to[order]
    n = int(max(state.max(initial=0), to.max(initial=0))) + 1
    first = np.searchsorted(state, np.arange(n + 1))
    degree = np.diff(first)
    room = 2 * max(len(state), n) + symbols
    used, taken, offset = np.zeros(room + symbols, bool), np.zeros(room, bool), np.zeros(n, np.int64)
    rng = np.random.default_rng(n)
    for low, high in ((64, symbols), (16, 63), (8, 15), (4, 7), (2, 3), (1, 1), (0, 0)):
        left = np.flatnonzero((degree >= low) & (degree <= high))
        while len(left):
            draw = rng.integers(0, room, len(left))
            size = degree[left]
            at = np.concatenate([[0], np.cumsum(size)])
            own = np.repeat(np.arange(len(left)), size)
            slot = draw[own] + symbol[np.repeat(first[left] - at[:-1], size) + np.arange(at[-1])]
            fits = ~taken[draw]
            fits[own[used[slot]]] = False
            live = fits[own]
            claimed, claim = np.unique(slot[live], return_index=True)
            late = np.ones(live.sum(), bool)
            late[claim] = False
            fits[own[live][late]] = False
            alone = np.zeros(len(left), bool)
            alone[np.unique(draw, return_index=True)[1]] = True
            fits &= alone
            used[slot[fits[own]]] = True
            taken[draw[fits]] = True
            offset[left[fits]] = draw[fits]
            left = left[~fits]
    out = np.full(len(used), -1, np.int64)
    out[offset[state] + symbol] = offset[state] << _NEXT | offset[to]
    return offset, out


class Model:
    """Automata of all languages.

    ``parts`` maps a language to (length of its reference, transitions as rows
    of state, code point, next state).
    """

    def __init__(self, parts: dict[str, tuple[int, np.ndarray]], limits: dict[str, float] | None = None) -> None:
        self.languages = sorted(parts)
        #: phrases a symbol from which a text is noise to the language
        self.limits = np.array([(limits or {}).get(k, 0.5) for k in self.languages])
        points = np.unique(np.concatenate([np.zeros(1, np.int64), *(parts[k][1][:, 1] for k in self.languages)]))
        self.size = len(points) + 1  # 0 for anything but letters, the reference's letters, and one for other letters
        self.table = np.zeros(0x110000, np.int32)
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = self.size - 1
        for k, point in enumerate(points[1:].tolist(), 1):
            for form in {chr(point), chr(point).upper()}:
                if len(form) == 1:
                    self.table[ord(form)] = k
        base, columns = [0], [np.zeros((0, 3), np.int64)]
        for lang in self.languages:
            steps = parts[lang][1]
            columns.append(np.stack([steps[:, 0] + base[-1], np.searchsorted(points, steps[:, 1]), steps[:, 2] + base[-1]], 1))
            base.append(base[-1] + int(steps[:, 2].max(initial=0)) + 1)
        state, symbol, to = np.concatenate(columns).T
        offset, self.slots = interleave(state, symbol, to, self.size)
        self.bits = [math.log2(max(2, parts[lang][0])) for lang in self.languages]
        self.home = offset[np.array(base[:-1], np.int64)][:, None]
        self.root = np.repeat(self.home, self.size, axis=1)
        for row, first in enumerate(base[:-1]):
            own = state == first
            self.root[row, symbol[own]] = offset[to[own]]

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, lane): the next states, and where a phrase starts with this symbol."""
        slot = self.slots.take(state + symbol)
        hit = (slot >> _NEXT) == state
        begins = ~hit | (state == self.home)
        return np.where(hit, slot & 0xFFFFFFFF, self.root.take(symbol, axis=1)), begins

    def phrases(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases (language, text) of the greedy parse of each text; ``at`` has the start of each and the end of the last."""
        begins = self.parse(symbols, at)[0]
        counts = np.zeros((len(self.languages), len(at) - 1), np.int64)
        some = np.diff(at) > 0
        if some.any():
            counts[:, some] = np.add.reduceat(begins, at[:-1][some], axis=1, dtype=np.int64)
        return counts

    def parse(self, symbols: np.ndarray, at: np.ndarray, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(language, symbol): where phrases begin in the greedy parse of each text; and the states behind the last symbol.

        ``entry`` has the states that the first text is entered in, for one that goes on from a block before.
        """
        size = np.diff(at)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = at[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, at[owner + 1] - start)
        begins = np.zeros((len(self.languages), len(symbols)), bool)
        states = np.zeros(begins.shape, np.int32)  # after each symbol
        order = np.argsort(-length, kind="stable")
        state = np.repeat(self.home, len(start), axis=1)
        if entry is not None and len(start):
            state[:, np.flatnonzero(order == 0)] = entry[:, None]
        active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        for t, k in enumerate(active.tolist()):
            where = start[order[:k]] + t
            state, begins[:, where] = self._step(state[:, :k], symbols[where])
            states[:, where] = state
        follows = np.flatnonzero(nth > 0)
        while len(follows):
            follows = self._carry(symbols, begins, states, follows, start, length)
        last = states[:, -1].astype(np.int64) if len(symbols) else self.home[:, 0] if entry is None else entry
        return begins, last

    def _carry(self, symbols, begins, states, lanes, start, length) -> np.ndarray:
        """Carry the parse of the lane before into each of ``lanes``; the lanes behind those whose end that changes."""
        entry = states[:, start[lanes] - 1].astype(np.int64)
        lang, lane = np.nonzero(entry != self.home)
        state, lane = entry[lang, lane], lanes[lane]
        home = self.home[lang, 0]
        changed = []
        for t in range(SEGMENT):
            if not len(lane):
                break
            where = start[lane] + t
            symbol = symbols[where]
            slot = self.slots.take(state + symbol)
            hit = (slot >> _NEXT) == state
            begins[lang, where] = ~hit | (state == home)
            state = np.where(hit, slot & 0xFFFFFFFF, self.root[lang, symbol])
            apart = states[lang, where] != state
            states[lang, where] = state
            ended = apart & (length[lane] == t + 1)
            changed.append(lane[ended])
            on = apart & ~ended
            lang, lane, state, home = lang[on], lane[on], state[on], home[on]
        after = np.unique(np.concatenate([np.zeros(0, np.int64), *changed])) + 1
        after = after[after < len(start)]
        return after[start[after] == start[after - 1] + SEGMENT] if len(after) else after

    def symbols(self, texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the texts, runs of 0 as one, and where each text's begin."""
        points = np.frombuffer(texts.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((texts.buf & 0xC0) != 0x80)])[texts.at]
        s = self.table[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[at[:-1][at[:-1] < len(s)]] = True
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[at]

    def _blocks(self, texts: kernel.Texts):
        """(symbols, at, goes on): the texts, or blocks of one long text."""
        limit = _over(self)
        if len(texts.at) != 2 or len(texts.buf) <= 2 * limit:
            yield *self.symbols(texts), False
            return
        start, last = 0, None
        while start < len(texts.buf):
            end = min(len(texts.buf), start + limit)
            while end < len(texts.buf) and texts.buf[end] & 0xC0 == 0x80:  # not inside a letter
                end += 1
            s, at = self.symbols(kernel.Texts(texts.buf[start:end], np.array([0, end - start])))
            if last == 0 and len(s) and s[0] == 0:  # a run that the block before began
                s, at = s[1:], at - np.array([0, 1])
            last = s[-1] if len(s) else last
            yield s, at, start > 0
            start = end

    def predict(self, texts: kernel.Texts, rows: int) -> dict:
        """``lang_pred``, ``score``, ``bits`` a symbol and ``told``, whether the text costs less than noise in the learned languages."""
        if not self.languages:
            return {"lang_pred": [UNDETERMINED] * rows, "score": np.zeros(rows), "bits": np.zeros(rows), "told": np.zeros(rows, bool)}
        size, letters_, count, cost = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros((len(self.languages), rows), np.int64), np.zeros(rows)
        entry = None
        for s, at, goes_on in self._blocks(texts):
            begins, entry = self.parse(s, at, entry if goes_on else None)
            size += np.diff(at)
            letters_ += np.diff(np.concatenate([[0], np.cumsum(s > 0)])[at])
            parts = -(-np.diff(at) // PART)
            if not len(s):
                continue
            of = np.repeat(np.arange(rows), parts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            phrases = np.add.reduceat(begins, at[of] + nth * PART, axis=1, dtype=np.int64)
            for k in range(len(self.languages)):
                count[k] += np.bincount(of, weights=phrases[k], minlength=rows).astype(np.int64)
            # each part in the language that it is cheapest in, in symbols of text that may cost as much
            cost += np.bincount(of, weights=(phrases / self.limits[:, None]).min(axis=0), minlength=rows)
        has = letters_ > 0
        bits = count * np.array(self.bits)[:, None] / np.maximum(1, size)
        best = bits.argmin(axis=0)
        least = bits[best, np.arange(rows)]
        random = math.log2(self.size)
        second = np.partition(bits, 1, axis=0)[1] if len(bits) > 1 else np.full(rows, random)
        score = np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)
        # phrases are whole numbers: one more, and the root of those expected, is no sign of noise
        limit = self.limits.min()
        told = has & (cost * limit <= size * limit + 1 + np.sqrt(size * limit))
        return {
            "lang_pred": [self.languages[b] if f else UNDETERMINED for b, f in zip(best, has, strict=True)],
            "score": np.where(has, score, 0.0), "bits": np.where(has, least, 0.0), "told": told,
        }


def held_out(id_col):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2; a null id is kept from it too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(True))


def learn(texts: list[str]) -> tuple[int, np.ndarray]:
    """Length and transitions (state, code point, next state) of the automaton of ``texts``."""
    symbols = [c for t in texts for c in letters(t)]
    steps = suffix_automaton(symbols)
    rows = [(s, c, to) for s, step in enumerate(steps) for c, to in step.items()]
    return len(symbols), np.array(rows, np.int64).reshape(-1, 3)


def noise(symbols: list[int], n: int = NOISE) -> list[int]:
    """Up to ``n`` symbols of the text with each letter replaced by any of its letters, all equally likely."""
    s = np.array(symbols[:n], np.int64)
    alphabet = np.unique(s[s > 0])
    drawn = np.random.default_rng(len(s)).choice(alphabet, len(s)) if len(alphabet) else s
    return np.where(s > 0, drawn, 0).tolist()


def noise_limit(learned: tuple[int, np.ndarray], taught: list[str], unseen: list[str]) -> float:
    """Phrases a symbol half-way between text of a language and random letters of it; without unseen text, half of noise's."""
    model = Model({"": learned})

    def rate(symbols: list[int]) -> float:
        if not symbols:
            return 0.0
        points = np.frombuffer("".join(chr(c) if c else " " for c in symbols).encode("utf-8", "surrogatepass"), np.uint8)
        s, at = model.symbols(kernel.Texts(points, np.array([0, len(points)])))
        return float(model.phrases(s, at)[0, 0]) / max(1, len(s))

    text, random = rate([c for t in unseen for c in letters(t)]), rate(noise([c for t in taught for c in letters(t)]))
    return max(0.05, (text + random) / 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled rows that are not held out.

    ``sample_docs`` documents of each language, those of the least hash of the
    id that have a text, are learned whole, each language in a task of its own,
    and ``SEEN_DOCS`` more show what its text costs; the driver receives the
    automata. Documents beyond ``SAMPLE_CHARS`` characters of a language are not
    taken; if the first is longer by itself, its first ``SAMPLE_CHARS`` are.
    """
    src = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), (~held_out(id_col)).alias("o"))
    usable = src.where("l IS NOT NULL AND o AND length(t) > 0")
    h = F.xxhash64("i", F.md5("t"))
    most = F.lit(SAMPLE_CHARS)
    first = Window.partitionBy("l").orderBy(F.col("n") > most, "h")
    ranked = usable.select("l", h.alias("h"), F.length("t").alias("n")).withColumn("r", F.row_number().over(first))
    some = ranked.where(F.col("r") <= sample_docs + SEEN_DOCS).withColumn("sum", F.sum("n").over(Window.partitionBy("l").orderBy("r")))
    chosen = some.where((F.col("sum") <= 2 * most) | (F.col("r") == 1)).select("l", "h", "r", "sum").collect()
    if not chosen:
        return Model({})
    ship(docs.sparkSession)
    taught_ = {(c["l"], c["h"]) for c in chosen if c["r"] <= sample_docs and c["sum"] <= SAMPLE_CHARS or c["r"] == 1}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, lang = pdf.sort_values("h"), pdf["l"].iloc[0]
        taught = [t for k, t in zip(pdf["h"], pdf["t"], strict=True) if (lang, k) in taught_]
        unseen = [t for k, t in zip(pdf["h"], pdf["t"], strict=True) if (lang, k) not in taught_]
        n, steps = learn(taught)
        return pd.DataFrame({"l": [lang], "n": [n], "steps": [steps.astype("<i4").tobytes()], "limit": [noise_limit((n, steps), taught, unseen)]})

    picked = usable.select("l", F.substring("t", 1, SAMPLE_CHARS).alias("t"), h.alias("h")).where(F.col("h").isin([r["h"] for r in chosen])).dropDuplicates(["l", "h"])
    parts = picked.groupBy("l").applyInPandas(build, "l string, n long, steps binary, limit double").collect()
    model = {r["l"]: (r["n"], np.frombuffer(r["steps"], "<i4").reshape(-1, 3).astype(np.int64)) for r in parts}
    return Model(model, {r["l"]: r["limit"] for r in parts})


def _over(model: Model) -> int:
    return max(1 << 16, CHUNK // max(1, len(model.languages)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits) of every row of ``docs``.

    ``lang_pred`` is a learned language, or ``und`` where the text is null or
    has no letter or nothing was learned; ``score`` is 1 less the ratio of the
    best estimate to the second best, from 0 to 1; ``bits`` is the best
    estimate, in bits a symbol. Ties go to the first language by name. Empty
    tables give empty results, repeated rows equal results, null ids are
    carried through, very long texts are parsed whole, and other columns are
    not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the rows learned
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            for i, j, texts in kernel.chunks(b.column(1), _over(m)):
                new = m.predict(texts, j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(new[k]) for k in ("lang_pred", "score", "bits"))],
                    names=["_id", "lang_pred", "score", "bits"],
                )

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(run, f"_id {id_type}, lang_pred string, score double, bits double")
    return out.withColumnRenamed("_id", id_col)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns.

    Rejects what ``predict`` calls ``und`` (null, empty and letterless texts)
    and texts whose parse costs more than half-way from a learned language to
    random letters of it: noise, and texts mostly in letters that no learned
    language has. Each part of a text may be in another language, so clean
    mixtures stay; short texts stay unless their phrases exceed the limit by more
    than one and the root of what it allows. Very long texts are parsed whole;
    repeated rows share their verdict; null ids need no care; an empty table
    gives an empty result; columns of any names pass through.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the rows learned
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            for i, j, texts in kernel.chunks(b.column(at), _over(m)):
                new = m.predict(texts, j - i)
                yield b.slice(i, j - i).filter(pa.array(new["told"]))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: predicted language of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits")
