"""Readers, writers and metadata."""
