"""Queries over the sample tables."""
