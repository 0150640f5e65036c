"""Scans of tables and of feature classes: rows with a ``ring``, or with ``x`` and ``y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.planar import ring_centroid
from tessera.operators.shapes import vertices

#: Fields that hold geometry or are derived from it, left out of attribute scans.
GEOMETRY_FIELDS = ("Shape", "Shape_Length", "Shape_Area", "ring")


def scan(spark: SparkSession, path: str, fields: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Chosen fields, all but geometry if none are chosen, of a Parquet table; columns and filter reach the files."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*fields) if fields else df.drop(*GEOMETRY_FIELDS)


def feature_points(df: DataFrame, fields: list[str] | None = None, all_points: bool = False) -> DataFrame:
    """A row for each vertex (``pnt_id``, ``x``, ``y``) or for each feature at its centroid."""
    keep = [c for c in df.columns if c != "ring"] if fields is None else fields
    if all_points:
        return vertices(df.select(*keep, "ring"))
    c = ring_centroid(F.col("ring"))
    return df.select(*keep, c["x"].alias("x"), c["y"].alias("y"))


def distinct_points(df: DataFrame) -> DataFrame:
    """One row for each place, that of the least id."""
    return df.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y")


def require_projected(crs: str) -> None:
    """Areas and angles are planar; geographic coordinates raise ValueError."""
    if crs != "projected":
        raise ValueError("planar measures need projected coordinates")
