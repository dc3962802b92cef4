"""Operators that also run on a streaming DataFrame.

All inputs of the workflow are finite, so there is no streaming job here. Operators without state or
aggregation work unchanged on ``readStream``: ``keys.pixel_key``, ``burden.catalytic_cases``,
``quality.drop_na_rows``, ``quality.tail_filter``, ``features.standardize`` with a fitted scaling,
``linear.pcr_predict`` and the ``transform`` of a fitted model.
"""
