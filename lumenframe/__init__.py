"""A PySpark-native engine for classic analytics kernels, built from DataFrame operations."""
