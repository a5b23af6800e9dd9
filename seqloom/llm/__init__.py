"""Operators for preparing training corpora: mixing, deduplication, filters, tokens and packing."""
