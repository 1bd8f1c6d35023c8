"""Structured Streaming entry points (fixture scoring)."""
