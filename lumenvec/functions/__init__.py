"""Scalar functions on weights."""
