"""Structured Streaming: documents that arrive continuously, and job status."""
