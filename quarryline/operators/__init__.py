"""Operators over tables of files, units, edges, chunks and hits; column names are parameters."""
