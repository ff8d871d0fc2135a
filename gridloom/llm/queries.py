"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, lines, merkle, mixing, neighbours, ngram_join, packing, pii, quality, recompression, toxicity, urls, whitening

QUERIES = {
    "op1_compression_bands": quality.op1_compression_bands,
    "op2_site_line_dedup": lines.op2_site_line_dedup,
    "op3_entropy_mix": mixing.op3_entropy_mix,
    "op4_association_urls": urls.op4_association_urls,
    "op5_multi_order_jaccard": ngram_join.op5_multi_order_jaccard,
    "op6_histogram_best_fit": packing.op6_histogram_best_fit,
    "op7_bootstrapped_pii": pii.op7_bootstrapped_pii,
    "op8_hilbert_neighbours": neighbours.op8_hilbert_neighbours,
    "op9_relational_chat": chat.op9_relational_chat,
    "op10_nearest_examples": toxicity.op10_nearest_examples,
    "op11_recompression_dedup": recompression.op11_recompression_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_tsqr_whitening": whitening.op13_tsqr_whitening,
}

SQL = {"op2_site_line_dedup": lines.OP2_SQL, "op5_multi_order_jaccard": ngram_join.OP5_SQL, "op9_relational_chat": chat.OP9_SQL, "op11_recompression_dedup": recompression.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL}
