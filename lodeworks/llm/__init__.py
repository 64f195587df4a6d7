"""Corpus operators: near-duplicates, canonical names, tokenizing, packing and text quality.

Nothing outside of this subpackage imports it; its queries register themselves if it can be imported.
"""
