"""Training-data operators (scoring, deduplication, filters, packing, extraction).

Nothing outside this subpackage imports it.
"""
