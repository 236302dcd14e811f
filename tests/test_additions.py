"""Embedding plug-ins, log sinks, review of comments, chunks of cut lines."""

import zlib

import numpy as np
import pytest

from larkspan.operators import embedding, rules
from larkspan.sources import corpus, sinks


def plain_vector(text, dimensions=embedding.DIMENSIONS):
    out = [0.0] * dimensions
    raw = " " + " ".join(text.lower().split()) + " " if text.strip() else ""
    for i in range(len(raw) - 2):
        h = zlib.crc32(raw[i : i + 3].encode())
        out[h % dimensions] += -1.0 if h >> 31 else 1.0
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out] if size else out


def test_embed_is_the_plain_vector(spark):
    texts = ["Hello  World", "", None, "é" * 5, "a", "hello world", "x y z " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r["id"]: r["embedding"] for r in embedding.embed(rows, "text", batch=2).collect()}
    for i, t in enumerate(texts):
        assert got[i] is None if t is None else got[i] == pytest.approx(plain_vector(t), abs=1e-6)
    assert got[0] == got[5]


def test_embed_takes_any_function_and_refuses_bad_vectors(spark):
    rows = spark.createDataFrame([("ab",), ("c",)], "text string").coalesce(1)
    sizes = embedding.embed(rows, "text", lambda ts: np.array([[len(t), 1.0] for t in ts]), out="v")
    assert [list(r["v"]) for r in sizes.collect()] == [[2.0, 1.0], [1.0, 1.0]]
    with pytest.raises(Exception, match="finite vectors"):
        embedding.embed(rows, "text", lambda ts: np.full((len(ts), 2), np.nan)).collect()


def test_log_is_rotated_by_size_and_lines(spark, tmp_path):
    row = spark.createDataFrame([(1, "x" * 100)], "n int, t string")
    schema = row.schema
    for folder, limits in ((f"file://{tmp_path}/a", {"max_bytes": 250}), (f"file://{tmp_path}/b", {"max_lines": 2})):
        seen = []
        for _ in range(7):
            sinks.append_log(row, folder, **limits)
            seen.append(sinks.read_log(spark, folder, schema).count())
        assert seen == [1, 2, 3, 4, 5, 3, 4]  # the sixth row fills a part that takes the place of the rotated one
    assert sinks.read_log(spark, f"file://{tmp_path}/none", schema).count() == 0


@pytest.mark.parametrize("text, want", [
    ("total = count + 1", "commented_code"), ("return value;", "commented_code"), ("if (x) {", "commented_code"), ("}", None),
    ("see ABC-123 for why", "history_tag"), ("Added in the spring release", "history_tag"), ("noqa: E501", None), ("---- ====", None),
    ("plain words about it", None), ("word " * 40, "long_inline"),
])
def test_comment_review(spark, text, want):
    from pyspark.sql import functions as F

    got = spark.range(1).select(rules.comment_finding(F.lit(text), F.lit(True), F.lit(False), F.lit(1)).alias("f")).first()["f"]
    assert got == want


def slow_chunks(text, most_lines, most_chars, overlap):
    """Line by line."""
    lines, out, first = text.split("\n"), [], 0
    while first < len(lines):
        if len(lines[first]) > most_chars:
            out += [(first + 1, first + 1, lines[first][k : k + most_chars]) for k in range(0, len(lines[first]), most_chars)]
            first += 1
            continue
        taken = [lines[first]]
        while first + len(taken) < len(lines) and len(taken) < most_lines and len("\n".join([*taken, lines[first + len(taken)]])) <= most_chars:
            taken.append(lines[first + len(taken)])
        if first + len(taken) < len(lines) and len(taken) > 40:
            marks = [k for k in range(30, len(taken)) if corpus.BOUNDARY.match(taken[k])]
            taken = taken[: marks[-1]] if marks else taken
        out.append((first + 1, first + len(taken), "\n".join(taken)))
        if first + len(taken) >= len(lines):
            break
        first += max(1, len(taken) - min(overlap, len(taken) // 5))
    return out


def test_chunks_of_awkward_files():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.choice((0, 1, 5, 60, 300))
        lines = [rnd.choice(("", "x" * rnd.randint(0, 40), "def f():", "# head", "  class A:", "y" * rnd.randint(90, 400))) for _ in range(n)]
        limits = rnd.choice((50, 80)), rnd.choice((100, 2000)), rnd.choice((0, 12))
        assert list(corpus.chunk_lines("\n".join(lines), *limits)) == slow_chunks("\n".join(lines), *limits)
