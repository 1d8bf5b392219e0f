"""Whole workloads and the registry of queries."""
