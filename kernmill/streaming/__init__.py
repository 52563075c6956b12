"""Incremental forms of operators whose state can be merged."""
