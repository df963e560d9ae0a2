"""Ordered incremental reads."""
