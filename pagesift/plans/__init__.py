"""Whole plans, and the queries registered with their SQL."""
