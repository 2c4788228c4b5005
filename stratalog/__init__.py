"""Spark-native analytics over content-addressed file catalogs."""
