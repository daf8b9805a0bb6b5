"""Spark-native Faraday tomography and spectral-cube analytics."""
