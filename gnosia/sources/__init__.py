"""Readers and writers of assertions."""
