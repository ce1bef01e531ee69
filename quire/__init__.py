"""Document analytics as PySpark DataFrame functions."""
