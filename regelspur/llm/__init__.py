"""Operators for building and cleaning training text. Nothing outside this folder imports it."""
