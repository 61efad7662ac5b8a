"""Operators of a large-scale training-data pipeline (ten operators, one module each).

Nothing else in the library imports this subpackage.  ``entry`` holds the registered queries.
"""
