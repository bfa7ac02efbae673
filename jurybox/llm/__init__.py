"""Operators for preparing training text, and the driver queries that apply them."""
