"""Training-data operators: deduplication, language, tokens, PII, HTML, packing.

Nothing outside this subpackage imports it.
"""
