"""Structured Streaming forms of the readiness, retry and redaction operators."""
