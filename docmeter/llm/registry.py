"""Queries of this subpackage by name, and the SQL that gives their rows where SQL can."""

from __future__ import annotations

from docmeter.llm import alignment, chat, language, licenses, minhash, neighbours, packing, pieces, pivots, planes, quality, sharding, whitening

QUERIES = {
    "op1_pivot_near_duplicates": pivots.query,
    "op2_bit_plane_tokens": planes.query,
    "op3_minhash_near_duplicates": minhash.query,
    "op4_batched_viterbi_pieces": pieces.query,
    "op5_word_first_language": language.query,
    "op6_hypergeometric_shards": sharding.query,
    "op7_chat_segments": chat.query,
    "op8_cutting_stock_packing": packing.query,
    "op9_sentence_rule_licenses": licenses.query,
    "op10_line_first_quality": quality.query,
    "op11_anchored_alignment": alignment.query,
    "op12_projected_neighbours": neighbours.query,
    "op13_chebyshev_whitening": whitening.query,
}

ORACLE_SQL = {
    "op1_pivot_near_duplicates": pivots.ORACLE_SQL,
    "op3_minhash_near_duplicates": minhash.ORACLE_SQL,
    "op7_chat_segments": chat.ORACLE_SQL,
    "op9_sentence_rule_licenses": licenses.ORACLE_SQL,
    "op10_line_first_quality": quality.ORACLE_SQL,
    "op12_projected_neighbours": neighbours.ORACLE_SQL,
}
