"""Operators for large-scale training text. Nothing outside this subpackage imports it."""
