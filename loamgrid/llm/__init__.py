"""Operators for preparing training text: each is a function on DataFrames.

Nothing outside this subpackage imports it.
"""
