"""Structured Streaming plans over event tables."""
