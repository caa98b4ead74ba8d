"""The registered training-data queries and their SQL twins."""

from __future__ import annotations

from docflow.llm import decontaminate, htmltext, imatch, langmodel, licenses, neardup, packing, pii, prefixtrie, quality, sharding, turnrepair, urlfilter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
    "op5_pii": pii.op5_pii,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_html_extraction": htmltext.op7_html_extraction,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_lm_scoring": langmodel.op10_lm_scoring,
    "op11_document_fingerprints": imatch.op11_document_fingerprints,
    "op12_conversation_repair": turnrepair.op12_conversation_repair,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}
ORACLES = {
    "op2_sharding": sharding.ORACLE_SQL,
    "op3_license_scan": licenses.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op12_conversation_repair": turnrepair.ORACLE_SQL,
    "op13_prefix_trie": prefixtrie.ORACLE_SQL,
}
