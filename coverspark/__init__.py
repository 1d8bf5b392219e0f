"""Spark jobs for land-cover maps as pixel tables, and operators for text corpora."""
