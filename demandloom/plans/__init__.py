"""Whole studies and the registered queries."""
