"""The corpus queries by name, and the SQL that checks them where SQL can express them."""

from . import bpe_codec, exact_dedup, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, suffix_dedup, token_counts

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_language_id": language_id.op2_language_id,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "quality_rules_base": quality_rules.quality_rules_base,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_ngram_jaccard_join": jaccard_join.OP6_SQL,
    "quality_rules_base": quality_rules.BASE_SQL,
}
