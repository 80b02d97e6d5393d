"""Relational operators on chunked arrays."""
