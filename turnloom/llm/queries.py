"""Queries and SQL of the subpackage."""

from __future__ import annotations

from turnloom.llm import bpe, chat, exact, licenses, lines, mix, near, ngram, pii, quality

QUERIES = {
    "op1_minhash": near.op1_minhash,
    "op2_mixing_sources": mix.op2_mixing_sources,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_class_ngrams": ngram.op4_class_ngrams,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_pii": pii.op7_pii,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_chat_formatting": chat.op10_chat_formatting,
}
ORACLE_SQL = {
    "op2_mixing_sources": mix.OP2_SQL,
    "op5_exact_dedup": exact.OP5_SQL,
    "op7_pii": pii.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
