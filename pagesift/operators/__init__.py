"""Operators over DataFrames of pages, findings and links."""
