"""Queries of the training-data operators and the pipeline, and their SQL where there is some."""

from __future__ import annotations

import corpus_pipeline

from . import chat, leaks, licenses, lines, merkle, near_dup, neighbours, packing, phrases, quality, recompress, secrets, token_files


def queries() -> dict:
    found = [
        neighbours.op1_additive_quantisation,
        packing.op2_best_fit_packing,
        near_dup.op3_minhash_near_dedup,
        quality.op4_attention_quality,
        licenses.op5_patience_licenses,
        secrets.op6_secret_scan,
        leaks.op7_latent_decontamination,
        recompress.op8_recompression_dedup,
        token_files.op9_arrow_token_files,
        lines.op10_line_dedup,
        chat.op11_typed_chat_parts,
        phrases.op12_phrase_collocations,
        merkle.op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op11_typed_chat_parts": chat.OP11_SQL.strip(), "op12_phrase_collocations": phrases.OP12_SQL.strip(), "op13_merkle_manifest": merkle.OP13_SQL.strip()}
