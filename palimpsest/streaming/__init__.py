"""Structured Streaming forms of masking and rehydration."""
