"""Operators for preparing training data: dedup, packing, scoring, chat formatting, search, tokenizing, PII."""
