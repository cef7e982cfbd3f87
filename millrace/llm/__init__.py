"""Operators over text corpora for training data, one module each, with their queries."""
