"""Operators for large text collections that feed language models.

Nothing else in the library imports this subpackage.
"""
