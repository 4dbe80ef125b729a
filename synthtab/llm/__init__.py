"""Operators for preparing training text: tokens, packing, filters, deduplication, decontamination."""
