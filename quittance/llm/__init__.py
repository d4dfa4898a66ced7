"""Operators for preparing training text, each built by one method on Spark tables.

Nothing else in the library imports this subpackage.
"""
