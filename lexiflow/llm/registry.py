"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (bm25, bpe_trie, cross_align, html_extract, lm_score, merkle, near_dup, packing, quality,
               sharding, token_counts, token_files, toxicity)

QUERIES = {
    "op1_trie_unigram": token_counts.op1_trie_unigram,
    "op2_backoff_automaton": lm_score.op2_backoff_automaton,
    "op3_hashed_ngram_llr": quality.op3_hashed_ngram_llr,
    "op4_virtual_slots": sharding.op4_virtual_slots,
    "op5_block_max_bm25": bm25.op5_block_max_bm25,
    "op6_class_kneser_ney": toxicity.op6_class_kneser_ney,
    "op7_wrapper_induction": html_extract.op7_wrapper_induction,
    "op8_minhash_forest": near_dup.op8_minhash_forest,
    "op9_prefix_trie_bpe": bpe_trie.op9_prefix_trie_bpe,
    "op10_minimum_bin_slack": packing.op10_minimum_bin_slack,
    "op11_fixed_width_ids": token_files.op11_fixed_width_ids,
    "op12_divide_at_cuts": cross_align.op12_divide_at_cuts,
    "op13_lag_lead_merkle": merkle.op13_lag_lead_merkle,
}

SQL = {
    "op8_minhash_forest": near_dup.SQL,
    "op13_lag_lead_merkle": merkle.SQL,
}


def spark_queries():
    return dict(QUERIES)


def sql_queries():
    return dict(SQL)
