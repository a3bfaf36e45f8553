"""Operators for preparing text corpora and free-typed values. Nothing else in the library imports this package."""
