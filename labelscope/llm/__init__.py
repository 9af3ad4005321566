"""Operators for preparing training text: near-duplicates, filters, scans, tokenizing, packing."""
