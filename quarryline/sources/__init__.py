"""Scans of source trees."""
