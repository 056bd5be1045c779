"""Operators that build good plans from DataFrame operations."""
