"""Operators over cell grids; each takes and returns DataFrames."""
