"""Structured Streaming forms of the chat filter and the report."""
