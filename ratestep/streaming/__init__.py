"""Structured Streaming front end and stateful processors."""
