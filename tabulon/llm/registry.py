"""The registered queries of the training-data operators."""

from __future__ import annotations

from tabulon.llm import embedding_dedup, filter_audit, license_scan, line_dedup, mixing, ngram_join, packing, pii, quality, secret_scan, sharding, url_filter, vector_codes

_MODULES = {
    "op1_nn_descent": embedding_dedup,
    "op2_pii_bootstrap": pii,
    "op3_mix_sources": mixing,
    "op4_line_quality": quality,
    "op5_license_minhash": license_scan,
    "op6_stratified_shards": sharding,
    "op7_secret_ownership": secret_scan,
    "op8_fuzzy_lines": line_dedup,
    "op9_cutting_stock": packing,
    "op10_ngram_jaccard_join": ngram_join,
    "op11_url_classifier": url_filter,
    "op12_lloyd_codes": vector_codes,
    "op13_filter_audit": filter_audit,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.ORACLE_SQL for name, m in _MODULES.items() if getattr(m, "ORACLE_SQL", None)}
