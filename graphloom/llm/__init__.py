"""Training-data operators for large text corpora.

Nothing outside this package imports it; `queries.py` holds the registered
queries and their SQL.
"""
