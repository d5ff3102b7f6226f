"""Whole queries over the shared tables."""
