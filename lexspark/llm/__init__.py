"""Operators for training-data pipelines.

Nothing outside this folder imports it.  ``queries.py`` holds the thin query
wrappers, every other module one operator.
"""
