"""Operators of labelled arrays, by family."""
