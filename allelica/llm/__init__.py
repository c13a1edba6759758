"""Operators for large-scale training-data pipelines.

Nothing else in :mod:`allelica` imports this subpackage; it can be removed
without affecting the genomics engine.
"""
