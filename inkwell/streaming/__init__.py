"""Structured Streaming jobs over event tables."""
