"""Structured Streaming forms of the scoring operators."""
