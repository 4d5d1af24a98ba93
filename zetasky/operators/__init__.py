"""Relational operators of the measurement."""
