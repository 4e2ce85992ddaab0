"""Operators that prepare document collections as training text."""
