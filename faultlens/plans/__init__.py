"""Dimension tables and the query registry."""
