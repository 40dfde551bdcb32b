"""Operators of a training-data pipeline: filtering, deduplication, privacy, packing and their relatives.

Nothing outside this subpackage imports it.
"""
