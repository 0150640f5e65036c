"""Planar geometry expressions on coordinates and on rings: ``array<struct<x:double,y:double>>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col

RING = "array<struct<x:double,y:double>>"


def point(x: Column | str, y: Column | str) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def squared_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """For comparing; the root is taken of what is kept."""
    return (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)


def direction(x0: Column, y0: Column, x1: Column, y1: Column, from_north: bool = False) -> Column:
    """Degrees of the way from the first point to the second: from the x axis, -180 to 180, or clockwise from north."""
    angle = F.degrees(F.atan2(y1 - y0, x1 - x0))
    return F.pmod(F.lit(450.0) - angle, F.lit(360.0)) if from_north else angle


def translate(x: Column, y: Column, dx: float | None, dy: float | None) -> tuple[Column, Column]:
    """Null shifts count as 0."""
    return x + F.lit(dx or 0.0), y + F.lit(dy or 0.0)


def rotate(x: Column, y: Column, degrees: float, cx: Column | None = None, cy: Column | None = None, clockwise: bool = False) -> tuple[Column, Column]:
    """About (cx, cy), the origin if not given."""
    a = math.radians(-degrees if clockwise else degrees)
    cos, sin = F.lit(math.cos(a)), F.lit(math.sin(a))
    cx, cy = (F.lit(0.0) if cx is None else cx), (F.lit(0.0) if cy is None else cy)
    dx, dy = x - cx, y - cy
    return dx * cos - dy * sin + cx, dx * sin + dy * cos + cy


def cross_product(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Positive where b lies left of the way from o to a."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def turn_angle(x0: Column, y0: Column, x1: Column, y1: Column, previous: Column) -> Column:
    """Direction of p0 seen from p1, less ``previous``, in [-pi, pi)."""
    return F.pmod(F.atan2(y0 - y1, x0 - x1) - previous, F.lit(2 * math.pi)) - math.pi


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether ab and cd cross properly; touching ends and parallels don't count."""
    side = lambda o, p, q: cross_product(*o, *p, *q)
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def line_intersection(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Where the lines through ab and cd meet; infinite coordinates for parallels."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = rx * sy - ry * sx
    t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / F.when(den != 0, den)
    inf = F.lit(float("inf"))
    return F.struct(F.coalesce(a[0] + t * rx, inf).alias("x"), F.coalesce(a[1] + t * ry, inf).alias("y"))


def jitter(c: Column, start: float = -1.0, end: float = 1.0, seed: int = 0) -> Column:
    return c + start + F.rand(seed) * (end - start)


def random_int(start: int, end: int, seed: int = 0) -> Column:
    """In [start, end)."""
    return (F.floor(F.rand(seed) * (end - start)) + start).cast("long")


# rings and lines


def _steps(ring: Column, f) -> Column:
    """``f(from, to)`` for each segment."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_length(ring: Column) -> Column:
    """Of all segments."""
    return F.when(F.size(ring) > 1, _sum(_steps(ring, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"])))).otherwise(F.lit(0.0))


def ring_area(ring: Column) -> Column:
    """Absolute area of a closed ring (shoelace)."""
    return F.when(F.size(ring) > 2, F.abs(_sum(_steps(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2).otherwise(F.lit(0.0))


def ring_centroid(ring: Column) -> Column:
    """Of the area of a closed ring; of a point or line the mean of its vertices."""
    o = F.element_at(ring, 1)
    w = lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])
    whole = _sum(_steps(ring, w))
    part = lambda c: o[c] + _sum(_steps(ring, lambda p, q: (p[c] + q[c] - 2 * o[c]) * w(p, q))) / (3 * whole)
    mean = lambda c: _sum(F.transform(ring, lambda p: p[c])) / F.size(ring)
    flat = (F.size(ring) < 4) | (whole == 0)
    return F.struct(F.when(flat, mean("x")).otherwise(part("x")).alias("x"), F.when(flat, mean("y")).otherwise(part("y")).alias("y"))


def ring_extent(ring: Column) -> Column:
    """struct L, B, R, T."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("L"), F.array_min(ys).alias("B"), F.array_max(xs).alias("R"), F.array_max(ys).alias("T"))


def extent_ring(box: Column) -> Column:
    """A closed clockwise ring of a struct L, B, R, T."""
    at = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(at("L", "B"), at("L", "T"), at("R", "T"), at("R", "B"), at("L", "B"))


def side_lengths(ring: Column, kind: str = "avg") -> Column:
    """Average, least or greatest side; the closing side counts."""
    d = _steps(ring, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    whole = {"avg": _sum(d) / F.size(d), "min": F.array_min(d), "max": F.array_max(d)}[kind]
    return F.when(F.size(ring) > 1, whole)


def vertex_angles(ring: Column) -> Column:
    """Unsigned degrees at each vertex: all of a closed ring, the inner ones of an open line."""
    n = F.size(ring)
    closed = (n > 3) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    around = F.when(closed, F.concat(F.slice(ring, n - 1, 1), ring)).otherwise(ring)
    m = F.size(around)

    def angle(p: Column, r: Column) -> Column:
        ux, uy, vx, vy = p["x"] - r["q"]["x"], p["y"] - r["q"]["y"], r["r"]["x"] - r["q"]["x"], r["r"]["y"] - r["q"]["y"]
        return F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy))

    pairs = F.zip_with(F.slice(around, 2, m - 2), F.slice(around, 3, m - 2), lambda q, r: F.struct(q.alias("q"), r.alias("r")))
    return F.when(m > 2, F.zip_with(F.slice(around, 1, m - 2), pairs, angle))


def signed_angles(line: Column) -> Column:
    """Degrees at the inner vertices of a line, 0 to 360 by the side it turns to; no wrap around a closure."""
    m = F.size(line)

    def angle(p: Column, r: Column) -> Column:
        ux, uy, vx, vy = r["q"]["x"] - p["x"], r["q"]["y"] - p["y"], r["q"]["x"] - r["r"]["x"], r["q"]["y"] - r["r"]["y"]
        return F.pmod(F.degrees(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)), F.lit(360.0))

    pairs = F.zip_with(F.slice(line, 2, m - 2), F.slice(line, 3, m - 2), lambda q, r: F.struct(q.alias("q"), r.alias("r")))
    return F.when(m > 2, F.zip_with(F.slice(line, 1, m - 2), pairs, angle))


def angles_summary(ring: Column, kind: str = "sum") -> Column:
    """Sum, min or max of the vertex angles other than 180 degrees."""
    a = F.filter(vertex_angles(ring), lambda v: F.abs(v - 180.0) > 1e-8)
    return {"sum": _sum(a), "min": F.array_min(a), "max": F.array_max(a)}[kind]


def point_along(ring: Column, value: float, use_fraction: bool = False) -> Column:
    """The point at a distance (or fraction, over 1 in percent) along a line; its end beyond."""
    total = ring_length(ring)
    want = total * (value / 100 if use_fraction and value > 1 else value) if use_fraction else F.lit(float(value))
    start = F.struct(F.lit(0.0).alias("gone"), F.element_at(ring, 1)["x"].alias("x"), F.element_at(ring, 1)["y"].alias("y"), F.element_at(ring, 1).alias("last"))

    def step(acc: Column, q: Column) -> Column:
        d = distance(acc["last"]["x"], acc["last"]["y"], q["x"], q["y"])
        t = F.when(d > 0, F.least(F.greatest((want - acc["gone"]) / d, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        here = acc["gone"] <= want
        return F.struct((acc["gone"] + d).alias("gone"), F.when(here, acc["last"]["x"] + t * (q["x"] - acc["last"]["x"])).otherwise(acc["x"]).alias("x"), F.when(here, acc["last"]["y"] + t * (q["y"] - acc["last"]["y"])).otherwise(acc["y"]).alias("y"), q.alias("last"))

    return F.aggregate(F.slice(ring, 2, F.size(ring) - 1), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def densify(ring: Column, factor: int = 2) -> Column:
    """``factor - 1`` equally spaced points inserted in each segment."""
    inner = _steps(ring, lambda p, q: F.transform(F.sequence(F.lit(0), F.lit(factor - 1)), lambda k: F.struct((p["x"] + (q["x"] - p["x"]) * k / factor).alias("x"), (p["y"] + (q["y"] - p["y"]) * k / factor).alias("y"))))
    return F.when(F.size(ring) > 1, F.concat(F.flatten(inner), F.slice(ring, -1, 1))).otherwise(ring)


def count_parts(parts: Column) -> Column:
    return F.size(parts)


def count_points(parts: Column) -> Column:
    """Vertices of all parts, closing ones left out."""
    return F.aggregate(F.transform(parts, lambda r: F.size(r)), F.lit(0), lambda a, n: a + n) - F.size(parts)


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside a closed ring: even-odd rule, points on the boundary excluded."""

    def crossing(p: Column, q: Column) -> Column:
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    def touches(p: Column, q: Column) -> Column:
        on_line = cross_product(p["x"], p["y"], q["x"], q["y"], x, y) == 0
        return on_line & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    odd = F.aggregate(_steps(ring, crossing), F.lit(0), lambda a, v: a + v) % 2 == 1
    return (F.size(ring) > 3) & odd & ~F.exists(_steps(ring, touches), lambda t: t)


def point_in_list(x: Column, y: Column, points: Column, eps: float = 1e-8) -> Column:
    """Whether a point of an array is at (x, y)."""
    return F.exists(points, lambda p: (F.abs(p["x"] - x) <= eps) & (F.abs(p["y"] - y) <= eps))
