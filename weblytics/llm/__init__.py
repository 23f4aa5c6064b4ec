"""Operators and the corpus pipeline for training-data preparation.

Every operator is a function of DataFrames with its own interface; the
registered queries (``queries.py``) derive digest columns from the results.
Nothing else in the library imports this subpackage.
"""
