"""Structured Streaming: live takes."""
