"""The queries of this package and, where SQL can express one, the SQL."""

from __future__ import annotations

from ampledger.llm import bpe, collocations, decontaminate, exact_dedup, html_text, pii, quality, repeats, simhash, token_counts, toxicity, url_filter, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_pii": pii.op5_pii,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_html_text": html_text.op7_html_text,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocations.op11_collocations,
    "op12_repeats": repeats.op12_repeats,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op6_url_filter": url_filter.OP6_SQL, "op11_collocations": collocations.OP11_SQL}
