"""Operators for preparing training data, their queries and SQL.

Nothing else in the library imports this package.
"""
