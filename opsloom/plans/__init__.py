"""Whole queries: evaluation, characterisation, catalogue, recipes."""
