"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin registered
queries and the SQL they are checked against.
"""
