"""Staging files, reports, logs and summaries."""
