"""Operators for preparing training text: filtering, deduplication, formatting and token work."""
