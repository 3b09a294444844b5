"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import audio, bases, conversation_trie, jaccard_join, license_scan, lm_scoring, mixing, packing, quality_rules, spelling, suffix_dedup, token_output, url_filter, winnowing

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_license_scans": license_scan.op6_license_scans,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_media_columns": audio.op8_media_columns,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op9_token_output": token_output.op9_token_output,
    "op11_decontamination": winnowing.op11_decontamination,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    **bases.QUERIES,
}

ORACLE_SQL = {"op1_url_filters": url_filter.SQL, "op11_decontamination": winnowing.SQL, **bases.ORACLE_SQL}
