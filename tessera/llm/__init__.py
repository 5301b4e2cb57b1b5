"""Operators for preparing large text and media corpora for model training.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` holds the registered queries and their SQL.
"""
