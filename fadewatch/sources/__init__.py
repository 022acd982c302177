"""Readers, writers and their integrity checks."""
