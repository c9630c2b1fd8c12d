"""Operators for text corpora and training sets. Nothing else in the library imports this package."""
