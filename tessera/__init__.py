"""Tabular and planar-geometry analytics expressed as Spark DataFrame operators."""
