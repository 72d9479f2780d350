"""Operators for building a training corpus from the ``documents`` and ``conversations`` tables.

Nothing else in the library imports this subpackage.
"""
