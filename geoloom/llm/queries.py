"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from geoloom.llm import decontaminate, jaccard_join, language_id, merkle, mixing, pii, quality, secrets, simhash, substring_dedup, topk_search, toxicity, whitening

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_topk": topk_search.op6_topk,
    "op7_pii": pii.op7_pii,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_language_id": language_id.op9_language_id,
    "op10_mixing": mixing.op10_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_merkle": merkle.op12_merkle,
    "op13_simhash": simhash.op13_simhash,
}

ORACLES = {
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_topk": topk_search.OP6_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
