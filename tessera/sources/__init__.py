"""Scans of files, logs and indexes, and the versioned store."""
