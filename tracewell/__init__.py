"""Interaction-history analytics as PySpark DataFrame operators."""
