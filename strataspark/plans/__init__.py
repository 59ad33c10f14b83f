"""Whole classifications and the registered queries."""
