"""Queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import op01_mix, op02_decontaminate, op03_lines, op04_language, op05_html, op06_media, op07_chat, op08_jaccard, op09_toxicity, op10_quality, op11_audit, op12_fingerprint, op13_alignment

QUERIES = {
    "op1_mix": op01_mix.op1_mix,
    "op2_decontaminate": op02_decontaminate.op2_decontaminate,
    "op3_lines": op03_lines.op3_lines,
    "op4_language": op04_language.op4_language,
    "op5_html": op05_html.op5_html,
    "op6_media": op06_media.op6_media,
    "op7_chat": op07_chat.op7_chat,
    "op8_jaccard": op08_jaccard.op8_jaccard,
    "op9_toxicity": op09_toxicity.op9_toxicity,
    "op10_quality": op10_quality.op10_quality,
    "op11_audit": op11_audit.op11_audit,
    "op12_fingerprint": op12_fingerprint.op12_fingerprint,
    "op13_alignment": op13_alignment.op13_alignment,
}

ORACLE_SQL = {"op3_lines": op03_lines.ORACLE_SQL, "op7_chat": op07_chat.ORACLE_SQL, "op8_jaccard": op08_jaccard.ORACLE_SQL, "op11_audit": op11_audit.ORACLE_SQL}
