"""Training-data operators: scoring, filtering, deduplication and encoding of web text.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
