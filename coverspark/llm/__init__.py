"""Operators for text corpora: deduplication, packing, tokenizing, sharding, archives and quality.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own
interface; ``queries.py`` derives the registered queries from them.
"""
