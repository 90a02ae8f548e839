"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from lattica.llm import decontaminate, hmm, jaccard, langid, mixing, pivots, render, secrets, sharding, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_hmm": hmm.op2_hmm,
    "op3_secrets": secrets.op3_secrets,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_pivots": pivots.op8_pivots,
    "op9_langid": langid.op9_langid,
    "op10_html": render.op10_html,
}

ORACLES = {"op1_mixing": mixing.OP1_SQL, "op6_ngram_jaccard": jaccard.OP6_SQL}
