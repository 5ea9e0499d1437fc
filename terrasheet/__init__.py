"""Raster-to-vector analytics on Spark: maps as pixel rows, segments, polygons, features, and their evaluation."""
