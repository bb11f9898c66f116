"""Operators for large training-data corpora: filtering, dedup, mixing, tokens, packing.

Nothing outside this subpackage imports it; ``queries`` holds its registered
queries and their SQL equivalents.
"""
