"""Training-data operators: extraction, filtering, deduplication, mixing, tokenizing, search and archives.

Nothing else in the library imports this subpackage.
"""
