"""Bulk domain intelligence on Spark."""
