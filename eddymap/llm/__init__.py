"""Operators for training-data pipelines; each module holds one of them.

Nothing else in the package imports this subpackage.
"""
