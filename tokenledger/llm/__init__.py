"""Operators for preparing training text: ten Spark jobs and their queries.

Nothing outside this subpackage imports it.
"""
