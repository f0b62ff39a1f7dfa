"""Helpers that all parts of the library use."""
