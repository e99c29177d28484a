"""Operators for building large training corpora, and the queries that apply them.

Nothing else in the library imports this subpackage; general helpers (the
shared scratch folder) come from the library.
"""
