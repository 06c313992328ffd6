"""Operators for preparing large-scale training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` binds the operators to the given tables.
"""
