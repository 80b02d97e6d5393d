"""Chunking of sequences that arrive as files."""
