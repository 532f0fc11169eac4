"""Reusable DataFrame operators: keep-first dedup, global NTILE, data-quality checks."""
