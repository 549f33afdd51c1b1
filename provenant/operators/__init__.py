"""Relational operators of evidence integrity."""
