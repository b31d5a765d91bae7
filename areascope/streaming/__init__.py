"""Incremental (restartable) processing of arriving chip files."""
