"""The registered queries of this subpackage and their DuckDB SQL (none where SQL cannot express the operator)."""

from __future__ import annotations

from . import fertility, fingerprint, language_id, mixing, near_dedup, packing, pii, prefix_trie, quality, \
    secrets_scan, suffix_dedup, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality_pu": quality.op2_quality_pu,
    "op3_pack": packing.op3_pack,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_pii": pii.op7_pii,
    "op8_imatch": fingerprint.op8_imatch,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_fertility_rules": fertility.op10_fertility_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_whitening": whitening.op12_whitening,
    "op13_secrets": secrets_scan.op13_secrets,
}

ORACLE = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
}
