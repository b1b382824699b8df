"""Inspection and observation analytics as PySpark DataFrame operators."""
