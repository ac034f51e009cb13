"""Operators for large text corpora (scoring, search, tokenizing, mixing, de-duplication, classifying).

Nothing else in the library imports this subpackage.
"""
