"""Relational operators of the translation dataflow."""
