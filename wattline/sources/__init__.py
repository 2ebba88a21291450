"""Scans, sinks and the canonical reading schema."""
