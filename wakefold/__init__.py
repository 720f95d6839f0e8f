"""Vessel-trajectory analytics as Spark DataFrame transformations."""
