"""Declarative streaming-join pipelines on Spark."""
