"""Structured Streaming: an extension beyond batch queries."""
