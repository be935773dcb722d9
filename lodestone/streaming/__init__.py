"""Structured Streaming forms of index maintenance."""
