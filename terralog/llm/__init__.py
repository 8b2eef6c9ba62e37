"""Operators of a training-data pipeline: quality, near copies, secrets, tokens, archives and packing.

Nothing outside this folder imports it. Queries are in :mod:`terralog.llm.queries`.
"""
