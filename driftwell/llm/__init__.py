"""Operators for preparing training text: language, toxicity, duplicates, leaks, tokens, records, URLs."""
