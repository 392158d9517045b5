"""Readers and stored results."""
