"""Operators for training-data pipelines: sharding, packing, dedup, filtering, extraction.

Nothing outside this subpackage imports it.
"""
