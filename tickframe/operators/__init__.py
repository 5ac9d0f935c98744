"""Operators over timestamped rows."""
