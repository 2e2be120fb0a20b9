"""Geospatial analytics as composable PySpark DataFrame operators."""
