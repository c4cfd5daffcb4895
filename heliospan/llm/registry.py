"""Queries of this subpackage, and their SQL where SQL can express them."""

from heliospan.llm import crossentropy, decontaminate, divergence, jaccard, language, lines, manifest, mixing, repeats, sharding, tokens, toxicity, vectors

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": language.op3_language,
    "op4_repeats": repeats.op4_repeats,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_cross_entropy": crossentropy.op6_cross_entropy,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_vectors": vectors.op8_vectors,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_mixing": mixing.op10_mixing,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_merkle": manifest.op13_merkle,
}
SQL = {
    "op1_sharding": sharding.SQL,
    "op8_vectors": vectors.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_mixing": mixing.SQL,
    "op11_line_dedup": lines.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_merkle": manifest.SQL,
}
