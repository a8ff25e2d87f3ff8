"""Operators for preparing training text: dedup, filters, search, mixing, packing."""
