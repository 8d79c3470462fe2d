"""Operators for preparing large text corpora: scoring, de-duplication, scanning, mixing, counting.

Every operator is a function from DataFrames to a DataFrame with its own general interface;
``queries.py`` derives the registered queries from them. Nothing outside this subpackage imports it.
"""
