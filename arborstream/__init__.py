"""Streaming forest sketches on PySpark."""
