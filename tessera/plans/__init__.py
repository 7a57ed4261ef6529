"""Operators composed into whole products."""
