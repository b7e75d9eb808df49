"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, and it imports nothing of
the rest.  Each module holds one operator with a general interface; ``queries``
holds the catalogue that applies each operator to its whole table.
"""
