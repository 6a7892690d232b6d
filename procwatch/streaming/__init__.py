"""Structured Streaming wiring around the same operators."""
