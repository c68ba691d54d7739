"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; the entry module adds
its queries only if it is present.
"""
