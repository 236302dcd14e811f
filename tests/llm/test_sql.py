"""The queries of this subpackage against their SQL, and the contracts of those that SQL cannot express, on whole tables."""

import duckdb
import pytest

from larkspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    out = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(cols)
    round_ = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(round_, df.select(*cols).collect())) == sorted(map(round_, out.fetchall()))


COLUMNS = {
    "op1_robust_outliers": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_popcount_simhash": ["doc_id", "fingerprint", "component_id"], "op4_cross_parsing_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_minimax_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_improbable_digest": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_document(spark, data, name):
    out = queries.QUERIES[name](spark, data)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    want = [r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(want)


def test_held_out_languages(spark, data):
    """Accuracy on the documents that were not learned from, for each language."""
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    hits: dict = {}
    for r in queries.QUERIES["op4_cross_parsing_langid"](spark, data).collect():
        if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und":
            hits.setdefault(truth[r["doc_id"]], []).append(r["lang_pred"] == truth[r["doc_id"]])
    assert len(hits) >= 3 and all(sum(h) >= 0.9 * len(h) for h in hits.values())
