"""Whole scans of tables."""
