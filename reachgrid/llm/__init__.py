"""Operators for large training corpora, their queries and oracle SQL.

Nothing outside this package imports it.
"""
