"""Continuous refresh of an index."""
