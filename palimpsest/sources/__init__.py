"""Readers and writers. Each reader returns a plain DataFrame."""
