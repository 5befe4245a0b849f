"""Sensor and weather time-series analytics as ordinary PySpark DataFrame operators."""
