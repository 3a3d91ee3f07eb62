"""Relational operators over meeting tables."""
