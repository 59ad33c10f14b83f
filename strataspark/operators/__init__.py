"""Operators over point and raster tables."""
