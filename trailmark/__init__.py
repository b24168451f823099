"""Browsing-log analytics on Spark."""
