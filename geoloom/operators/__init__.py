"""Operators over points, polygons, raster cells and daily series."""
