"""Operators for preparing training text: filters, deduplication, mixing and tokens.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
