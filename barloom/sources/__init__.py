"""Readers, writers, file checks and version records."""
