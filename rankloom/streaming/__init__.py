"""Structured Streaming: record checks and windowed counts over unbounded input."""
