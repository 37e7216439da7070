"""The queries of this subpackage, one an operator, and SQL for those that it can express."""

from __future__ import annotations

from meshqa.llm import bpe, counts, fingerprints, hosts, mixing, neardup, quality, sharding, tokenfile, toxicity

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_token_files": tokenfile.query,
    "op3_token_counts": counts.query,
    "op4_mix_sources": mixing.query,
    "op5_bpe_round_trip": bpe.query,
    "op6_kd_shards": sharding.query,
    "op7_toxicity": toxicity.query,
    "op8_url_filter": hosts.query,
    "op9_document_fingerprints": fingerprints.query,
    "op10_simhash_groups": neardup.query,
}

ORACLES = {"op4_mix_sources": mixing.ORACLE_SQL, "op8_url_filter": hosts.ORACLE_SQL}
