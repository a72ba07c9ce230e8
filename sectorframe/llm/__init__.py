"""Operators for preparing training text, with the queries that apply them.

Nothing outside this subpackage imports it.
"""
