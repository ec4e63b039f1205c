"""Extractors: file text to units and edges."""
