"""Incremental counts with Structured Streaming, an extension."""
