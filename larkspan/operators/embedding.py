"""Embedding as a plug-in: any function from a batch of texts to vectors, and a deterministic one that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from larkspan.session import ship

DIMENSIONS = 64


def hashed_ngrams(texts: list[str], dimensions: int = DIMENSIONS, n: int = 3) -> np.ndarray:
    """Unit vectors of signed counts of character n-grams, by a hash; a text without any is a zero vector."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = f" {' '.join(text.lower().split())} " if text.strip() else ""
        h = np.fromiter((zlib.crc32(raw[i : i + n].encode()) for i in range(len(raw) - n + 1)), np.uint32)
        np.add.at(row, (h % dimensions).astype(np.int64), np.where(h >> 31, -1.0, 1.0).astype(np.float32))
        size = float(np.sqrt(np.square(row, dtype=np.float64).sum()))
        if size:
            row /= size
    return out


def embed(
    docs: DataFrame, text: str, embed_batch: Callable[[list[str]], np.ndarray] = hashed_ngrams, out: str = "embedding", batch: int = 256,
) -> DataFrame:
    """``docs`` with the vector of ``text`` in ``out``; a null text has a null vector.

    ``embed_batch`` gets at most ``batch`` texts at a time and returns one row
    of finite numbers for each, all of one length; anything else is an error.
    It is built once a task, so a model that it holds is loaded once a task.
    """
    ship(docs.sparkSession)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        width = None
        for part in parts:
            vectors: list = []
            for i in range(0, len(part), batch):
                texts = part.iloc[i : i + batch]
                given = texts[texts.notna()]
                got = np.asarray(embed_batch(list(given)), np.float32).reshape(len(given), -1) if len(given) else np.zeros((0, width or 0), np.float32)
                if not np.isfinite(got).all() or (len(got) and (not got.shape[1] or width not in (None, got.shape[1]))):
                    raise ValueError("an embedder must return finite vectors of one length")
                width = got.shape[1] if len(got) else width
                rows = iter(got.tolist())
                vectors += [next(rows) if t is not None else None for t in texts.where(texts.notna(), None)]
            yield pd.Series(vectors, dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))
