"""Composed results: statistics and the live snapshot."""
