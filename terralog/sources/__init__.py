"""Readers of landed files and payloads, and table layers."""
