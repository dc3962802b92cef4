"""Operators of a training-data pipeline: search, counts, filters, deduplication, mixing, sharding.

Nothing outside this folder imports it. ``queries`` holds the registered queries and their SQL.
"""
