"""A PySpark-native engine for raster, vector and evidence tables."""
