"""Operators for preparing training text and vectors; nothing else in the library imports this package."""
