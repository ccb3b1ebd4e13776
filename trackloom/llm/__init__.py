"""Operators for large-scale training-data pipelines.

Every operator takes DataFrames and column names, selects only the columns it
needs (so extra columns with any name are harmless) and returns a DataFrame.
``queries.py`` derives the contract columns of the ``opN_*`` queries.
"""
