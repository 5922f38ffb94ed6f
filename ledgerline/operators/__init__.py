"""Relational operators over filings."""
