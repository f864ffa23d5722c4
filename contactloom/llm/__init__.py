"""Corpus-preparation operators (toxicity, quality, dedup, mixing, packing, ...).

Nothing else in the library imports this subpackage.
"""
