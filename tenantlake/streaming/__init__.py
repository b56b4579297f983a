"""Structured Streaming jobs over arriving files and metric points."""
