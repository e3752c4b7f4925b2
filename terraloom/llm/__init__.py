"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface plus a thin query function over the tables
of the synthetic corpus.
"""
