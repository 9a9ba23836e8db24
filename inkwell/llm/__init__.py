"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may use the library's
general helpers. ``queries.py`` registers one query per operator.
"""
