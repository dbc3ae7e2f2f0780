"""Operators on training texts; nothing else in the library imports this package."""
