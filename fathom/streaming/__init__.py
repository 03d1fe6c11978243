"""Incremental (Structured Streaming) forms of the catalogue jobs."""
