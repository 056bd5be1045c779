"""Queries and multi-step programs built from the operators."""
