"""Operators for preparing training data; nothing else in this library imports them."""
