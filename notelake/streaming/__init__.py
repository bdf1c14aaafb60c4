"""Structured Streaming forms of the upkeep operators."""
