"""Incremental forms of the run analysis."""
