"""Operators for training text and free-entered names. Nothing outside this subpackage imports it."""
