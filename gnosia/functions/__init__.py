"""Scalar functions over terms, dates and text."""
