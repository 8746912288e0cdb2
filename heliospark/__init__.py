"""A PySpark-native engine for multi-instrument time series."""
