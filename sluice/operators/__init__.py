"""Relational operators of the money-flow engine."""
