"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from korvex.llm import ann, exact_dedup, html, mixing, packing, quality, secrets, simhash, tokencount, toxicity

QUERIES = {
    "op1_html_extraction": html.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_nearest_neighbours": ann.query,
    "op4_toxicity": toxicity.query,
    "op5_mixing": mixing.query,
    "op6_token_counts": tokencount.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_packing": packing.query,
    "op9_quality_classifier": quality.query,
    "op10_secret_scan": secrets.query,
}

ORACLES = {
    "op5_mixing": mixing.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
}
