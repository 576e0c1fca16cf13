"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    op1_jaccard_join,
    op2_quality_rules,
    op3_license_scan,
    op4_sharding,
    op5_chat_preference,
    op6_mixing,
    op7_suffix_dedup,
    op8_line_dedup,
    op9_decontamination,
    op10_toxicity,
    op11_conversation_repair,
    op12_fingerprints,
    op13_collocations,
)

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join.query,
    "op2_quality_rules": op2_quality_rules.query,
    "op3_license_scan": op3_license_scan.query,
    "op4_sharding": op4_sharding.query,
    "op5_chat_preference": op5_chat_preference.query,
    "op6_mixing": op6_mixing.query,
    "op7_suffix_dedup": op7_suffix_dedup.query,
    "op8_line_dedup": op8_line_dedup.query,
    "op9_decontamination": op9_decontamination.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_conversation_repair": op11_conversation_repair.query,
    "op12_fingerprints": op12_fingerprints.query,
    "op13_collocations": op13_collocations.query,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": op2_quality_rules.ORACLE,
    "op3_license_scan": op3_license_scan.ORACLE,
    "op4_sharding": op4_sharding.ORACLE,
    "op5_chat_preference": op5_chat_preference.ORACLE,
    "op6_mixing": op6_mixing.ORACLE,
    "op9_decontamination": op9_decontamination.ORACLE,
    "op13_collocations": op13_collocations.ORACLE,
}
