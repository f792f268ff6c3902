"""Sensitive-data posture analytics on PySpark."""
