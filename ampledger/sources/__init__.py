"""Readers, and adapters from the benchmark tables."""
