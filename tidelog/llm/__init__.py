"""Operators that prepare training text and vectors; nothing else in the library imports them."""
