"""Structured Streaming wrappers around the batch plans."""
