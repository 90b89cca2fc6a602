"""Structured Streaming over a growing transcript cache."""
