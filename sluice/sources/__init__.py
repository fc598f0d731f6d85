"""Readers and keyed tables."""
