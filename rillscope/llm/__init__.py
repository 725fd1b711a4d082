"""Operators for preparing large-scale training text.

Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries and their SQL.
"""
