"""Training-data operators: archives, tokenisation, deduplication, packing, media.

Nothing else in the package imports this subpackage.
"""
