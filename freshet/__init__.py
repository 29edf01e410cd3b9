"""Flood-risk analytics as Spark DataFrame operators."""
