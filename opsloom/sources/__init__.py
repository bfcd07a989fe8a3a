"""Readers of raw job records."""
