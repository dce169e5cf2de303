"""Operators for training text; nothing outside this package imports it."""
