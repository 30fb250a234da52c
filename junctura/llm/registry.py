"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, jaccard_join, language_id, line_dedup, merkle, pii, quality_classifier, quality_rules, spelling, suffix_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_pii": pii.op8_pii,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_merkle": merkle.op11_merkle,
    "op12_language_id": language_id.op12_language_id,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
