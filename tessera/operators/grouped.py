"""Kernels applied to features or groups of points, distributed by key.

A group is one feature (a hull, a tree, a triangulation), so its points go to one task
together; groups are independent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels

VERTEX = "part int, pnt_id int, x double, y double"


def _xy(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["x", "y"]].dropna().to_numpy(dtype=np.float64)


def _ring_rows(key: object, part: int, ring: np.ndarray, name: str) -> pd.DataFrame:
    return pd.DataFrame({name: key, "part": np.int32(part), "pnt_id": np.arange(len(ring), dtype=np.int32), "x": ring[:, 0] if len(ring) else [], "y": ring[:, 1] if len(ring) else []})


def _by_group(df: DataFrame, group: str, kernel: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Vertex rows of the rings that a kernel makes of each group's points."""
    kind = df.schema[group].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [_ring_rows(key[0], i, r, group) for i, r in enumerate(kernel(_xy(pdf)))]
        return pd.concat(rows) if rows else _ring_rows(key[0], 0, np.empty((0, 2)), group)

    return df.select(group, "x", "y").groupBy(group).applyInPandas(run, f"{group} {kind}, {VERTEX}")


def convex_hulls(df: DataFrame, group: str) -> DataFrame:
    """Closed rings. The hull of a group is that of its parts' hulls, so each task first reduces
    what it has of a group, and only those corners are gathered."""
    kind = df.schema[group].dataType.simpleString()

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.dropna(subset=["x", "y"]).groupby(group, dropna=False, sort=False):
                hull = kernels.convex_hull(_xy(part))
                yield pd.DataFrame({group: pd.Series([key] * len(hull), dtype=pdf[group].dtype), "x": hull[:, 0], "y": hull[:, 1]})

    corners = df.select(group, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(reduce, f"{group} {kind}, x double, y double")
    return _by_group(corners, group, lambda p: [kernels.convex_hull(p)])


# The walk, the triangulation and the tree below depend on all points of a group at once: a
# group is one feature, whose points have to fit one task's memory.


def concave_hulls(df: DataFrame, group: str, k: int = 3) -> DataFrame:
    return _by_group(df.select(group, "x", "y").distinct(), group, lambda p: [kernels.concave_hull(p, k)])


def triangulate(df: DataFrame, group: str) -> DataFrame:
    """Delaunay triangles, one part each, three open vertices."""
    return _by_group(df.select(group, "x", "y").distinct(), group, lambda p: list(kernels.distinct_sorted(p)[kernels.delaunay(p)]))


def voronoi_cells(df: DataFrame, group: str, clip_to_extent: bool = False) -> DataFrame:
    """Closed Voronoi cells, one part each, optionally clipped to the group's extent."""

    def cells(p: np.ndarray) -> list[np.ndarray]:
        rings = [r for _, r in kernels.voronoi(p)]
        if clip_to_extent and len(p):
            rings = [c for r in rings for c in kernels.clip_box(r, p[:, 0].min(), p[:, 1].min(), p[:, 0].max(), p[:, 1].max())]
        return rings

    return _by_group(df.select(group, "x", "y").distinct(), group, cells)


def spanning_trees(df: DataFrame, group: str) -> DataFrame:
    """Minimum spanning tree edges ``Orig, Dest, Dist``; indices of the group's points by (x, y)."""
    kind = df.schema[group].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = kernels.spanning_tree(_xy(pdf)) if len(pdf) > 1 else []
        return pd.DataFrame({group: [key[0]] * len(edges), "Orig": [e[0] for e in edges], "Dest": [e[1] for e in edges], "Dist": [e[2] for e in edges]})

    return df.select(group, "x", "y").groupBy(group).applyInPandas(run, f"{group} {kind}, Orig int, Dest int, Dist double")


def _flat(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All rings' points end to end, and where each ring begins; a null ring has none."""
    points = rings.flatten()
    xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y")])
    return xy, np.concatenate(([0], np.cumsum(rings.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))))


def _per_ring(df: DataFrame, key: str, kernel: Callable[[np.ndarray], list[tuple[int, np.ndarray]]]) -> DataFrame:
    """``key, part, ring``: the numbered parts that a kernel makes of each row's ring; one batch out for each in.

    The rows are dealt out first, for a small file can hold millions of rings in one split."""
    kind = df.schema[key].dataType.simpleString()
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy, cuts = _flat(batch.column(1))
            rows, numbers, rings = [], [], [np.empty((0, 2))]
            for i in range(batch.num_rows):
                for number, ring in kernel(xy[cuts[i] : cuts[i + 1]]):
                    rows.append(i)
                    numbers.append(number)
                    rings.append(ring)
            sizes = np.array([len(r) for r in rings[1:]], dtype=np.int64)
            out = np.concatenate(rings)
            corners = pa.StructArray.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["x", "y"])
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows, dtype=np.int64))), pa.array(np.array(numbers, dtype=np.int32)), pa.ListArray.from_arrays(ends, corners)], [key, "part", "ring"])

    dealt = df.select(key, "ring").repartition(tasks, F.xxhash64(key, "ring"))
    return dealt.mapInArrow(run, f"{key} {kind}, part int, ring array<struct<x:double,y:double>>")


def _vertices(parts: DataFrame, key: str) -> DataFrame:
    return parts.select(key, "part", F.posexplode("ring").alias("pnt_id", "p")).select(key, "part", "pnt_id", "p.x", "p.y")


def split_rings(df: DataFrame, key: str, how: str, factor: float, axis: str = "X") -> DataFrame:
    """``key, part, ring`` of the parts, numbered along the axis; a concave polygon can have several in one strip, each its own part."""
    return _per_ring(df, key, lambda r: list(enumerate(kernels.split_polygon(r, how, factor, axis))))


def split_polygons(df: DataFrame, key: str, how: str, factor: float, axis: str = "X") -> DataFrame:
    """Vertex rows of :func:`split_rings`."""
    return _vertices(split_rings(df, key, how, factor, axis), key)


def split_by_sector(df: DataFrame, key: str, n: int) -> DataFrame:
    """Vertex rows; the part number is ``wedge * 100000 + sector piece``."""
    return _vertices(_per_ring(df, key, lambda r: [(w * 100_000 + i, p) for w, pieces in enumerate(kernels.split_sectors(r, n)) for i, p in enumerate(pieces)]), key)


def clip_polygons(df: DataFrame, key: str, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Vertex rows of the parts that each polygon has inside an extent."""
    return _vertices(_per_ring(df, key, lambda r: list(enumerate(kernels.clip_box(r, left, bottom, right, top)))), key)


def triangle_rings(df: DataFrame, key: str) -> DataFrame:
    """``key, part, ring`` of the Delaunay triangles of each polygon's vertices whose centroid lies inside the polygon; rings are open."""

    def parts(r: np.ndarray) -> list[tuple[int, np.ndarray]]:
        tri = kernels.distinct_sorted(r)[kernels.delaunay(r)]
        return list(enumerate(tri[kernels.inside(tri.mean(axis=1), r)])) if len(tri) else []

    return _per_ring(df, key, parts)


def triangulate_polygons(df: DataFrame, key: str) -> DataFrame:
    """Vertex rows of :func:`triangle_rings`."""
    return _vertices(triangle_rings(df, key), key)


def geodesic(lon0: Column | str, lat0: Column | str, lon1: Column | str, lat1: Column | str) -> Column:
    """struct Distance_m, Orig_Bearing, Dest_Bearing."""

    @F.pandas_udf("Distance_m double, Orig_Bearing double, Dest_Bearing double")
    def inverse(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        dist, start, end = kernels.geodesic_inverse(a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy())
        return pd.DataFrame({"Distance_m": dist, "Orig_Bearing": start, "Dest_Bearing": end}).astype(object).where(lambda t: t.notna(), None)

    return inverse(lon0, lat0, lon1, lat1)


def spaced_points(df: DataFrame, key: str, space: float, n: int, seed: int = 0) -> DataFrame:
    """Spaced random points in each extent (``key, L, B, R, T``)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                p = kernels.spaced_points(r.L, r.B, r.R, r.T, space, n, seed)
                yield pd.DataFrame({key: getattr(r, key), "pnt_id": np.arange(len(p), dtype=np.int32), "x": p[:, 0], "y": p[:, 1]})

    return df.select(key, "L", "B", "R", "T").mapInPandas(run, f"{key} {kind}, pnt_id int, x double, y double")


def geodesic_measures(df: DataFrame, key: str) -> DataFrame:
    """``length_km`` and ``area_km2`` of rings of longitudes and latitudes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy, cuts = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kernels.geodesic_lengths(xy, cuts) / 1e3), pa.array(kernels.geodesic_areas(xy, cuts) / 1e6)], [key, "length_km", "area_km2"])

    return df.select(key, "ring").mapInArrow(run, f"{key} {kind}, length_km double, area_km2 double")
