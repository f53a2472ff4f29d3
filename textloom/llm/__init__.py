"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it; it can be deleted without touching the rest.
"""
