"""Scenarios and the catalogue of queries."""
