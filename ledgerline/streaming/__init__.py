"""Incremental and windowed operators, batch and streaming."""
