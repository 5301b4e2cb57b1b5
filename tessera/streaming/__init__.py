"""Structured Streaming forms of incremental maintenance."""
