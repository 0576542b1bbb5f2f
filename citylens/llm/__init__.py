"""Operators for preparing training text: scoring, deduplication, secrets, mixing, tokenising.

Nothing else in the library imports this subpackage.
"""
