"""Incremental refresh fed by new files."""
