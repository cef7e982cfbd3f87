"""Composition of operators from code and from declarative steps."""
