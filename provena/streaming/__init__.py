"""Structured Streaming forms of the keyed, timed state."""
