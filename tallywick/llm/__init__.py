"""Operators for training-data pipelines: text tables in, text tables, files or decisions out.

Nothing else in the library imports this subpackage.
"""
