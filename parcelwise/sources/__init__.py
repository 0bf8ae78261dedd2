"""Scans, sinks and parsers."""
