"""Training-data operators: scoring, deduplication, packing, encoding and mixing of text.

Nothing outside this subpackage imports it.
"""
