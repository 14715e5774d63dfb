"""Training-data operators: tokenising, extraction, packing, filters, scans and near-duplicate search.

Nothing outside this package imports it.
"""
