"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries and their SQL; each operator has a module of its own.
"""
