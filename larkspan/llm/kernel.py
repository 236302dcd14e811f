"""Vectorised text primitives for Arrow batches.

Works on the UTF-8 bytes of many documents at once. Words are runs of bytes
other than 0x20 and 0x09-0x0D; these are ASCII, so runs of bytes are runs of
code points. A span is hashed eight bytes at a time, each step a bijection of
the block followed by a full mix, so structured texts collide no more often
than random ones; spans over ``LONG`` bytes go through XXH3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspan.session import ship

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian block.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Longest span in bytes that is hashed in numpy.
LONG = 512
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Texts:
    """The bytes of consecutive texts: ``buf``, and ``at`` with the start of each text and the end of the last."""

    def __init__(self, buf: np.ndarray, at: np.ndarray) -> None:
        self.buf, self.at = buf, at
        self._blocks = None

    @property
    def blocks(self) -> np.ndarray:
        """The eight bytes that begin at each byte, as a little-endian number, with zeros behind the end."""
        if self._blocks is None:
            padded = np.zeros((len(self.buf) // 8 + 2) * 8, np.uint8)
            padded[: len(self.buf)] = self.buf
            self._blocks = np.lib.stride_tricks.as_strided(padded.view("<u8"), (len(self.buf) + 1,), (1,))
        return self._blocks

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, the same wherever they stand."""
        size = end - start
        h = mix(size.astype(U) + _STEP)
        at = np.flatnonzero((size > 0) & (size <= LONG))
        k = 0
        while len(at):
            left = size[at] - k
            block = self.blocks[start[at] + k] & _FIRST[np.minimum(left, 8)]
            h[at] = mix(h[at] ^ block) * _STEP
            at = at[left > 8]
            k += 8
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.buf[start[i] : end[i]].tobytes())
        return mix(h)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of ``inside``, cut where texts meet."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and the index of each text's first word (with the number of words at the end)."""
        start, end = self.runs(~SEPARATOR[self.buf])
        return start, end, np.searchsorted(start, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``words``, for the pieces that a split at newlines gives; an empty text has one empty line."""
        breaks = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        per = np.searchsorted(breaks, self.at)
        first = per + np.arange(len(self.at))
        end = np.empty(len(start), np.int64)
        end[first[1:] - 1] = self.at[1:]
        inner = np.ones(len(start), bool)
        inner[first[1:] - 1] = False
        end[inner] = breaks
        return start, end, first

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The number of flagged bytes of each text."""
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[self.at])


def windows(h: np.ndarray, n: int, multiplier: int = 0xD1B54A32D192ED03) -> np.ndarray:
    """Hashes of every ``n`` consecutive elements of ``h``; the last n-1 positions are left out."""
    m, out, have = U(multiplier), None, 0
    step, width = h, 1
    while True:  # binary decomposition of n, longest blocks last
        if n & width:
            out = step[: len(step)] if out is None else mix(out[: max(0, min(len(out), len(step) - have))] * m + step[have : have + len(out)][: max(0, len(step) - have)])
            have += width
        if have == n:
            return out
        step = mix(step[: max(0, len(step) - width)] * m + step[width:])
        width *= 2


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each element, from the index of each text's first element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) for pieces of about ``limit`` bytes; null counts as an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, Texts(whole[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[Texts, int], dict], schema: str) -> DataFrame:
    """``mapInArrow`` over ``df``: ``keep`` columns pass through, ``fn(texts, rows)`` gives the new ones.

    ``schema`` describes the kept columns, then those of ``fn`` by name.
    """
    ship(df.sparkSession)
    out_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_schema)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for i, j, texts in chunks(batch.column(names.index(text))):
                new = fn(texts, j - i)
                cols = [batch.column(names.index(k)).slice(i, j - i) for k in keep]
                cols += [pa.array(new[f.name], f.type) if not isinstance(new[f.name], pa.Array) else new[f.name] for f in list(arrow)[len(keep):]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out_schema)
