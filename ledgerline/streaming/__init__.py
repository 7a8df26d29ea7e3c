"""Continuous forms of the engine's metrics by Structured Streaming."""
