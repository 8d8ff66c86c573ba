"""Detectors, page-level ranking and report rendering."""
