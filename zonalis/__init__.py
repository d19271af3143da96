"""Spatial priority analytics as Spark DataFrame operators."""
