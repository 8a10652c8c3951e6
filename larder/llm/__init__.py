"""Operators for preparing training text: deduplication, scans, scoring, packing, encoding and archives."""
