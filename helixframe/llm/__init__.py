"""Training-data operators: classification, deduplication, search, packing, tokenising.

Nothing else in ``helixframe`` imports this subpackage.
"""
