"""Incremental and event-time operators."""
