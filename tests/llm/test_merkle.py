"""Merkle manifests against a plain tree of each language."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from larkspan.llm import merkle, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row, sorted."""
    langs = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf(r) for r in langs[x]]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for p, r in enumerate(langs[x]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            node, proof = leaf(r | {"text": r["text"].translate(LOW)}) if tampered else leaf(r), ""
            for tree, at in ((trees[x], p), (top, k)):
                for level in tree[:-1]:
                    first = at - at % 8
                    run = level[first : first + 8]
                    proof += "".join(run[: at - first] + run[at - first + 1 :])
                    node = sha("".join(run[: at - first]) + node + "".join(run[at - first + 1 :]))
                    at //= 8
            out.append((r["doc_id"], trees[x][0][p], trees[x][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def check(df, **options):
    got = merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    want = brute([r.asDict() for r in df.collect()])
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


def test_the_query_on_a_whole_table(spark, data):
    want = brute([r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()])
    got = queries.QUERIES["op12_superblock_merkle"](spark, data)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, i long, node string, at long, part int, total int, `_id` string"


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_nulls_ties_repeated_rows_long_texts_and_clashing_names(spark, depth):
    """Trees of one leaf, of 8, 9, 64 and 65, a null language and one that is the empty string, ids that repeat or are null."""
    rnd, rows = random.Random(3), []
    for lang, n in ((None, 9), ("", 1), ("a", 8), ("b", 64), ("ü", 65), ("Z", 30), ("c=d", 2)):
        for k in range(n):
            text = rnd.choice([None, "", "ABC Ü", f"Text {k} " * 20, "x" * 200_000 if k == 3 else "Y"])
            rows.append((rnd.choice([None, k, 5]), text, lang, rnd.choice([None, "s:1"]), rnd.choice([None, 7])))
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "t", 1, "n", 2, 3, 4, "i") for r in rows], SCHEMA).repartition(5)
    check(df, levels=depth)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "One", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert check(df)[0][4] == sha("")  # a lone leaf is subroot and root, with no siblings
    assert merkle.manifest(df.where("false")).count() == 0
    two = spark.createDataFrame([(1, "One", "en", "s", 3)] * 2, df.schema)
    check(two)


def test_without_tampering_all_is_verified(spark, data):
    out = merkle.manifest(spark.read.parquet(f"{data}/documents.parquet"), levels=2)
    assert out.where("NOT verified").count() == 0 and out.select("root").distinct().count() == 1
