"""Batch and stream operators over event frames."""
