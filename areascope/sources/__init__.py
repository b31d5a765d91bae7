"""Scans, sinks and cached tables."""
