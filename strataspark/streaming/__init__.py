"""Incremental classification of arriving tiles."""
