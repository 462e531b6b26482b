"""Parsing and planning of S-expression queries."""
