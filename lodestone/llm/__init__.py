"""Operators for large training corpora, each a function from DataFrame to DataFrame."""
