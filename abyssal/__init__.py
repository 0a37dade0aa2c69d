"""Spark-native analytics for multi-channel seafloor time series."""
