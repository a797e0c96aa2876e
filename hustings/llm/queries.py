"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import edit_embedding, html_extraction, jaccard, language_model, line_dedup, media, merkle, mixing, packing, quality, secrets, sharding, whitening

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_media_columns": media.op3_media_columns,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_mixing_sources": mixing.op7_mixing_sources,
    "op8_lm_scoring": language_model.op8_lm_scoring,
    "op9_sharding": sharding.op9_sharding,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_document_fingerprints": edit_embedding.op13_document_fingerprints,
}
SQL = {"op1_secret_scans": secrets.OP1_SQL, "op2_quality_rules": quality.OP2_SQL, "op5_line_dedup": line_dedup.OP5_SQL, "op11_merkle_manifest": merkle.OP11_SQL}
