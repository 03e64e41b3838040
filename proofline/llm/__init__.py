"""Operators for preparing training data: scoring, search, de-duplication, extraction, archives, packing.

Nothing else in the library imports this subpackage.
"""
