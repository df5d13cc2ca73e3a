"""Operators for preparing training text: search, mixing, scoring, scans, extraction, tokenising, dedup, filters."""
