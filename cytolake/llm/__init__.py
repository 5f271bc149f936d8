"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and ``components``/``common`` hold what several operators share.
"""
