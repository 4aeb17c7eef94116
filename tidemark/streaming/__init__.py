"""Structured Streaming operators over the archive log."""
