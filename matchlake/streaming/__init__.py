"""Incremental forms of the forecast log."""
