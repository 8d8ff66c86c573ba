"""Readers that turn pages into nodes and elements."""
