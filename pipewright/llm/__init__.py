"""Operators for training-data pipelines: mixing, deduplication, filtering, extraction, sharding.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries.
"""
