"""Operators for large training-data corpora; one module an operator.

Nothing outside this subpackage imports it.  ``queries.py`` registers the ``opN_*`` queries.
"""
