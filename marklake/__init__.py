"""Rows stay the truth; vectors, marks and rules are columns and joins over them."""

__version__ = "0.1.0"
