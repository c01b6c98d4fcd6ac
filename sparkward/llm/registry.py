"""Queries of the corpus operators, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from sparkward.llm import decontamination, edit_fingerprints, embedding_dedup, hard_negatives, mixing, secret_scans, simhash, suffix_dedup, token_counts, toxicity, url_filters, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_edit_fingerprints": edit_fingerprints.op2_edit_fingerprints,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_secret_scans": secret_scans.op7_secret_scans,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op4_url_filters": url_filters.OP4_SQL, "op11_embedding_dedup": embedding_dedup.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
