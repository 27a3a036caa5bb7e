"""Operators that prepare large text corpora for training.

Every operator takes DataFrames and returns a DataFrame. Nothing outside this package imports it.
"""
