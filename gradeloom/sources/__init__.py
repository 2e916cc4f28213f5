"""Readers, writers and the input views built on the given tables."""
