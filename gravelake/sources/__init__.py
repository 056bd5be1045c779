"""Generators, readers and writers."""
