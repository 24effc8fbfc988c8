"""Operators for preparing training data: language, quality, deduplication, tokens and packing.

Nothing outside this folder imports it.
"""
