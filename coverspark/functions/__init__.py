"""Scalar helpers."""
