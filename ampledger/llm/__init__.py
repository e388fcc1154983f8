"""Training-data operators: dedup, near-dedup, tokenization, extraction, filtering.

Nothing outside this package imports it; it can be removed as a whole.
"""
