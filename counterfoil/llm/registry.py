"""Queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import (byte_bpe, hard_negatives, html_text, jaccard_join, language_id, line_dedup, packing, prefix_trie, quality_rules,
               secret_scan, suffix_dedup, topk_search, url_filter)

QUERIES = {
    "op1_secret_scans": secret_scan.op1_secret_scans,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_byte_level_bpe": byte_bpe.op5_byte_level_bpe,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_conversation_trie": prefix_trie.op12_conversation_trie,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {
    "op1_secret_scans": secret_scan.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op6_url_filters": url_filter.OP6_SQL,
    "op11_suffix_dedup": suffix_dedup.OP11_SQL,
    "op12_conversation_trie": prefix_trie.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
