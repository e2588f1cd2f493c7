"""Operators for training-data corpora: token output, toxicity, deduplication, language, licences, mixing.

Nothing outside this subpackage imports it.
"""
