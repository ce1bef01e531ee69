"""Structured Streaming forms of the job operators."""
