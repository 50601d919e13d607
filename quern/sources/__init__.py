"""Readers, writers, path index and media sampling arithmetic."""
