"""Operators for large text corpora, one module per operator; nothing outside imports this package."""
