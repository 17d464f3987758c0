"""Incident evidence analytics as Spark DataFrame programs."""
