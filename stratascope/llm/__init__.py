"""Operators of a training-data pipeline: mixing, personal data, search, classifiers, filters and deduplication.

Nothing outside this package imports it. ``queries`` holds the registered queries and their SQL.
"""
