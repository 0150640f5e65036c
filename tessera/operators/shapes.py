"""Generators and reshapings of points, lines and polygons.

Polygons and lines are ``array<struct<x,y>>``; ``vertices`` lays them out a row for each vertex."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.planar import point, rotate
from tessera.functions.text import grid_code


def vertices(df: DataFrame, ring: str = "ring", closing: bool = True) -> DataFrame:
    """A row for each vertex: ``pnt_id`` from 0, ``x``, ``y``; without the last one if not ``closing``."""
    r = F.col(ring)
    if not closing:
        r = F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    keep = [c for c in df.columns if c != ring]
    return df.select(*keep, F.posexplode(r).alias("pnt_id", "__p")).select(*keep, "pnt_id", F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


def rings(df: DataFrame, key: str, order: str = "pnt_id", close: bool = False) -> DataFrame:
    """Vertex rows to one ring for each key, in the order given."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    out = df.groupBy(key).agg(ring.alias("ring"))
    return out.withColumn("ring", closed(F.col("ring"))) if close else out


def closed(ring: Column) -> Column:
    """The first vertex once more at the end, where it isn't there."""
    return F.when(F.element_at(ring, 1) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def single_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part: ``part_id`` and ``ring``."""
    return df.select(*[c for c in df.columns if c != parts], F.posexplode(parts).alias("part_id", "ring"))


def lines(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Two-point lines."""
    return df.withColumn("ring", F.array(point(x0, y0), point(x1, y1)))


def _lattice(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """0-based ``row``, ``col`` and row-major ``n``."""
    n = spark.range(rows * cols)
    return n.select(F.col("id").alias("n"), F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))


def mesh_points(spark: SparkSession, left: float, bottom: float, right: float, top: float, dx: float, dy: float, top_down: bool = True) -> DataFrame:
    """Lattice points that reach the far edges or the first step beyond: ``Pnt_num``, ``X``, ``Y``, the same
    as ``Xs`` and ``Ys`` for labels, and ``RowCol``. Rows go down from the top or up from the bottom."""
    dx, dy = abs(dx), abs(dy)
    nx, ny = math.ceil((right - left) / dx - 1e-9) + 1, math.ceil((top - bottom) / dy - 1e-9) + 1
    x = F.lit(float(left)) + F.col("col") * float(dx)
    y = F.lit(float(top)) - F.col("row") * float(dy) if top_down else F.lit(float(bottom)) + F.col("row") * float(dy)
    label = F.format_string("r%03d c%03d", "row", "col")
    return _lattice(spark, ny, nx).select(F.col("n").alias("Pnt_num"), x.alias("X"), y.alias("Y"), x.alias("Xs"), y.alias("Ys"), label.alias("RowCol"))


def circle_ring(radius: float, step: float, cx: Column | float = 0.0, cy: Column | float = 0.0) -> Column:
    """Points at 180, 180 - step, ... -180 degrees; closed."""
    cx, cy = (c if isinstance(c, Column) else F.lit(float(c)) for c in (cx, cy))
    n = int(round(360 / step))
    a = lambda k: F.radians(F.lit(180.0) - k * F.lit(360.0 / n))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct((cx + F.lit(float(radius)) * F.cos(a(k))).alias("x"), (cy + F.lit(float(radius)) * F.sin(a(k))).alias("y")))


def n_gon(sides: int, radius: float) -> Column:
    """A regular polygon; closed."""
    return circle_ring(radius, 360 / sides)


def infinity_circle(df: DataFrame, factor: float = 10.0) -> DataFrame:
    """37 points far around the points (x, y): at ``factor`` times the larger extent from their mean."""
    a = df.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("size"))
    unit = circle_ring(1.0, 10.0)
    return a.select(F.posexplode(unit).alias("pnt_id", "u"), "cx", "cy", "size").select("pnt_id", (F.col("cx") + F.col("u.x") * F.col("size") * max(factor, 1.0)).alias("x"), (F.col("cy") + F.col("u.y") * F.col("size") * max(factor, 1.0)).alias("y"))


def spiral(spark: SparkSession, n: int, turns: int, clockwise: bool = False, reverse: bool = False) -> DataFrame:
    """Archimedes' spiral: angle i * pi / ``turns``, radius the angle. ``clockwise`` reverses the order, ``reverse`` swaps x and y."""
    g = spark.range(n)
    phi = F.col("id") / turns * math.pi
    x, y = phi * F.cos(phi), phi * F.sin(phi)
    place = (F.lit(n - 1) - F.col("id")) if clockwise else F.col("id")
    return g.select(place.alias("pnt_id"), (y if reverse else x).alias("x"), (x if reverse else y).alias("y"))


def square_spiral(spark: SparkSession, n: int, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """``n`` steps west, south, east, north, ..., whose lengths go 1, 1, 2, 2, 3, 3, ...; ``pnt_id`` 0 is the start.

    Closed form: step i goes ceil(i / 2) far, so the sums along each direction are
    those of arithmetic series."""
    g = spark.range(n + 1).withColumn("i", F.col("id"))
    # turns done in each direction after i steps: west 1, 5, ...; south 2, 6, ...; east 3, 7, ...; north 4, 8, ...
    times = lambda d: F.greatest(F.floor((F.col("i") + 4 - d) / 4), F.lit(0))
    total = lambda d: times(d) * F.lit((d + 1) // 2) + times(d) * (times(d) - 1)
    return g.select(F.col("id").alias("pnt_id"), (F.lit(float(x)) + total(3) - total(1)).cast("double").alias("x"), (F.lit(float(y)) + total(4) - total(2)).cast("double").alias("y"))


def spiral_order(rows: Column, cols: Column, row: Column, col: Column) -> Column:
    """0-based place of a cell on the clockwise spiral from the upper left corner inwards."""
    k = F.least(row, col, rows - 1 - row, cols - 1 - col)
    before = 2 * k * (rows + cols - 2 * k)
    h, w = rows - 2 * k, cols - 2 * k
    r, c = row - k, col - k
    along = F.when(r == 0, c).when(c == w - 1, w - 1 + r).when(r == h - 1, w - 1 + h - 1 + (w - 1 - c)).otherwise(2 * (w - 1) + h - 1 + (h - 1 - r))
    return (before + along).cast("long")


def sectors(spark: SparkSession, radius: float, step: float, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """Triangles of the centre and two points of a circle: ``sector`` and ``ring``."""
    n = int(round(360 / step))
    at = lambda k: F.struct((F.lit(float(cx)) + float(radius) * F.cos(F.radians(F.lit(180.0) - k * step))).alias("x"), (F.lit(float(cy)) + float(radius) * F.sin(F.radians(F.lit(180.0) - k * step))).alias("y"))
    center = F.struct(F.lit(float(cx)).alias("x"), F.lit(float(cy)).alias("y"))
    return spark.range(n).select(F.col("id").alias("sector"), F.array(center, at(F.col("id")), at(F.col("id") + 1), center).alias("ring"))


def code_grid(spark: SparkSession, cols: int, rows: int, zero_based: bool = False, bottom_up: bool = False) -> DataFrame:
    """Labels A01, B01, ...: ``row`` and ``col`` from 0, ``code``."""
    if cols > 702:
        raise ValueError("columns beyond ZZ have no label")
    g = _lattice(spark, rows, cols)
    line = (F.lit(rows - 1) - F.col("row")) if bottom_up else F.col("row")
    return g.select("row", "col", grid_code(F.col("col"), line + (0 if zero_based else 1)).alias("code"))


#: Corners of the unit cells, closed; hexagons have radius 1.
CELLS = {
    "rectangle": [[(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]],
    "triangle": [[(0, 0), (0.5, 1), (1, 0), (0, 0)], [(0.5, 1), (1.5, 1), (1, 0), (0.5, 1)]],
    "hex_flat": [[(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (180, 120, 60, 0, -60, -120, -180)]],
    "hex_pointy": [[(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (150, 90, 30, -30, -90, -150, -210)]],
}


def sampling_grid(spark: SparkSession, kind: str, x: float, y: float, dx: float, dy: float, cols: int, rows: int, angle: float = 0.0) -> DataFrame:
    """Cells of a sampling grid, row-major: ``cell`` from 0, ``code`` and a closed ``ring``.

    ``rectangle``; ``triangle`` (two a cell); ``hex_flat``: columns 1.5 dx apart, odd ones
    moved by sqrt(3)/2 dy, corners scaled by dy; ``hex_pointy``: rows 1.5 dy apart, odd
    ones moved by sqrt(3)/2 dx, corners scaled by dx and dy. ``angle`` turns the grid
    counter-clockwise about its corner (x, y)."""
    h = math.sqrt(3) / 2
    g = _lattice(spark, rows, cols)
    row, col = F.col("row"), F.col("col")
    if kind == "hex_flat":
        ox, oy, sx, sy = col * (1.5 * dx), row * (2 * h * dy) + (col % 2) * (h * dy), dy, dy
    elif kind == "hex_pointy":
        ox, oy, sx, sy = col * (2 * h * dx) + (row % 2) * (h * dx), row * (1.5 * dy), dx, dy
    else:
        ox, oy, sx, sy = col * dx, row * dy, dx, dy

    def corner(px: float, py: float) -> Column:
        rx, ry = rotate(ox + px * sx, oy + py * sy, angle)
        return F.struct((F.lit(float(x)) + rx).alias("x"), (F.lit(float(y)) + ry).alias("y"))

    shapes = F.array(*[F.array(*[corner(float(a), float(b)) for a, b in ring]) for ring in CELLS[kind]])
    n = len(CELLS[kind])
    code = grid_code(col, row + 1)
    return g.select((F.col("n") * n).alias("first"), code.alias("code"), F.posexplode(shapes).alias("k", "ring")).select((F.col("first") + F.col("k")).cast("long").alias("cell"), "code", "ring")


def transects(spark: SparkSession, n: int, x: float, y: float, dist: float, x_offset: float = 0.0, y_offset: float = 0.0, bearing: float | list[float] = 0.0, top_left: bool = False) -> DataFrame:
    """Parallel lines ``X_from, Y_from, X_to, Y_to`` at a bearing from north; a list of bearings gives one line for each."""
    bearings = bearing if isinstance(bearing, list) else [bearing] * n
    step_y = -y_offset if top_left else y_offset
    b = F.radians(F.element_at(F.array(*[F.lit(float(v)) for v in bearings]), F.col("id").cast("int") + 1))
    g = spark.range(len(bearings)).withColumns({"X_from": F.lit(float(x)) + F.col("id") * float(x_offset), "Y_from": F.lit(float(y)) + F.col("id") * float(step_y)})
    return g.select(F.col("id").alias("line_id"), "X_from", "Y_from", (F.col("X_from") + F.sin(b) * float(dist)).alias("X_to"), (F.col("Y_from") + F.cos(b) * float(dist)).alias("Y_to"))
