"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, fingerprints, hard_negatives, jaccard_join, line_dedup, mixing, pieces, quality_classifier, quality_rules, secrets, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_sharding": sharding.op2_sharding,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_pieces": pieces.op8_pieces,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_alignment": alignment.op11_alignment,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_secrets": secrets.op13_secrets,
}
ORACLES = {"op4_quality_rules": quality_rules.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
