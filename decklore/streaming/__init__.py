"""Structured Streaming: question intake and sessions."""
