"""Catalogue scans and table sinks."""
