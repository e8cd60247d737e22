"""Structured Streaming versions of operators with state."""
