"""Structured Streaming forms of the stateless row rules."""
