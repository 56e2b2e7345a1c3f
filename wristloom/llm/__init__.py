"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each operator is a function from
DataFrames to a DataFrame; `queries.py` binds them to the given tables.
"""
