"""Scans, sinks and the versioned table store."""
