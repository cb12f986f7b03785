"""Training-data operators: deduplication, filtering, mixing and tokenisation.

Nothing else in the library imports this subpackage.
"""
