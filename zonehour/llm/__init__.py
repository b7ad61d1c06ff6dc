"""Operators for preparing training text: ten operators, their queries, and their SQL.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
