"""Readers: bytes or text to node tables."""
