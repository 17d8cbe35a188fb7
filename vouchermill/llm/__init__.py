"""Operators for preparing training text: near duplicates, contamination, scoring, tokens, archives."""
