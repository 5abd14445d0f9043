"""Training-data operators: quality, safety, deduplication, mixing and tokenization.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
