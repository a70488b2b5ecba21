"""cuelark: timed-text processing and training-data operators on PySpark."""
