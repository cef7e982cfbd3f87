"""Scalar functions and formula text."""
