"""Operators for preparing training text: deduplication, filtering, scoring, mixing and packing."""
