"""Negative-constraint text analytics on PySpark."""
