"""Operators for preparing large collections of training text. Nothing outside this package imports it."""
