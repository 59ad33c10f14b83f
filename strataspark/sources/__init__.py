"""Readers and writers of point-cloud and drawing files."""
