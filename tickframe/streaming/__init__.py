"""Structured Streaming forms of order-sensitive operators."""
