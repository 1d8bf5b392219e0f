"""Operators over pixel tables."""
