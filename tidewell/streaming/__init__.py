"""Structured Streaming execution."""
