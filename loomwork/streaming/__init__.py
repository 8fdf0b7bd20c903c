"""Structured Streaming jobs over attempt events."""
