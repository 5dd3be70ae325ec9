"""Operators for text and sequence training data. Nothing outside this package imports it."""
