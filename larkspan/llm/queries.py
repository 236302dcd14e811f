"""The opN queries and their SQL."""

from __future__ import annotations

from larkspan.llm import digests, langid, linededup, merkle, minhash, mixing, outliers, packing, phrases, sharding, simhash, substrings, weaklabels

QUERIES = {
    "op1_robust_outliers": outliers.query,
    "op2_popcount_simhash": simhash.query,
    "op3_conflict_best_fit": packing.query,
    "op4_cross_parsing_langid": langid.query,
    "op5_range_line_dedup": linededup.query,
    "op6_systematic_mix": mixing.query,
    "op7_minimax_shards": sharding.query,
    "op8_improbable_digest": digests.query,
    "op9_weak_label_quality": weaklabels.query,
    "op10_relative_lz": substrings.query,
    "op11_sketched_collocations": phrases.query,
    "op12_superblock_merkle": merkle.query,
    "op13_circulant_minhash": minhash.query,
}
ORACLES: dict = {
    "op5_range_line_dedup": linededup.ORACLE,
    "op6_systematic_mix": mixing.ORACLE,
    "op10_relative_lz": substrings.ORACLE,
    "op11_sketched_collocations": phrases.ORACLE,
}
