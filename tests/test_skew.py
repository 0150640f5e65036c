"""Operators where one value has all rows, one point lies far off, or points coincide."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grouped, points, tables, windows
from tessera.plans.ordered import Ordered, medians


def test_one_value_in_all_rows_is_numbered_over_blocks(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 50 == 7, F.lit("b")).otherwise(F.lit("a")).alias("v"), (F.col("id") % 3).cast("double").alias("x"))
    seen, sums = {}, {}
    got = windows.occurrence(df, "v", ["id"]).orderBy("id").collect()
    total = {r.id: r.s for r in windows.cumulative_sum(df, "x", ["id"], "s", ["v"]).collect()}
    for r in got:
        seen[r.v] = seen.get(r.v, 0) + 1
        sums[r.v] = sums.get(r.v, 0.0) + r.x
        assert r.k == seen[r.v] and total[r.id] == sums[r.v]


def test_sums_by_value_with_nulls_in_few_and_many_blocks(spark):
    rows = [(i, None if i % 4 == 0 else i % 3, None if i % 5 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    for blocks in (1, 7):
        got = {r.id: r.s for r in Ordered(df, ["g", "id"], blocks=blocks).with_sum_by("s", F.col("v"), ["g"]).df.collect()}
        state = {}
        for i, g, v in rows:
            if v is not None:
                state[g] = state.get(g, 0) + v
            assert got[i] == state.get(g)


@pytest.mark.parametrize("n", [1, 2, 9, 10])
def test_medians(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([1.0, 2.0, rng.random()])) for g in ("a", "b") for _ in range(n)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in medians(df, "v", "g").collect()}
    assert got == {g: pytest.approx(float(np.median([v for k, v in rows if k == g]))) for g in ("a", "b")}
    stats = {r.Field: r for r in tables.field_statistics(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]).collect()}
    assert stats["v"].N == 2 * n and stats["w"].N == 0 and stats["w"].Med is None


def test_total_with_reset_carries_on_after_nulls(spark):
    values = [-5.0, None, 4.0, 5.0, -20.0, None, None, 3.0]
    df = spark.createDataFrame([(g, i, v) for g in "ab" for i, v in enumerate(values)], "g string, id int, v double")
    for g in "ab":
        got = [r.cumulative for r in windows.cumulative_with_reset(df, "v", ["id"], ["g"]).where(F.col("g") == g).orderBy("id").collect()]
        assert got == [-5.0, 0.0, 4.0, 9.0, -11.0, 0.0, 0.0, 3.0]


def brute(origins, targets, k, same):
    out = {}
    for i, x, y in origins:
        near = sorted(((u - x) ** 2 + (v - y) ** 2, j) for j, u, v in targets if not (same and i == j))[:k]
        out[i] = [(n + 1, j, pytest.approx(math.sqrt(d))) for n, (d, j) in enumerate(near)]
    return out


@pytest.mark.parametrize("kind", ["outlier", "one place", "two clusters", "few"])
def test_nearest_under_skew(spark, kind):
    rng = random.Random(2)
    rows = {
        "outlier": [(i, rng.random(), rng.random()) for i in range(300)] + [(999, 1e6, 1e6)],
        "one place": [(i, 1.0, 2.0) for i in range(200)] + [(500 + i, rng.random(), 2.0) for i in range(20)],
        "two clusters": [(i, rng.random() * 1e-6, 0.0) for i in range(120)] + [(200 + i, 1e5 + rng.random(), 5.0) for i in range(40)],
        "few": [(1, 0.0, 0.0), (2, 1.0, 1.0)],
    }[kind]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for same in (True, False):
        got = {}
        for r in points.nearest(df, df, 3, exclude_same=same).collect():
            got.setdefault(r.id, []).append((r.n, r.id2, r.d))
        assert {i: sorted(v) for i, v in got.items()} == brute(rows, rows, 3, same)


def test_points_in_polygons_of_very_different_sizes(spark):
    square = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    polygons = [(i, square(i % 10 * 1.0, i // 10 * 1.0, 0.9)) for i in range(100)] + [(1000, square(-1e5, -1e5, 3e5)), (1001, square(4.0, 4.0, 7.0))]
    rng = random.Random(3)
    pts = [(i, rng.uniform(-1, 12), rng.uniform(-1, 12)) for i in range(200)] + [(900, 5e4, 5e4)]
    want = {}
    for i, x, y in pts:
        hit = [k for k, r in polygons if r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]]
        want[i] = min(hit)
    df = spark.createDataFrame(polygons, "poly_id long, ring array<struct<x:double,y:double>>")
    got = {r.id: r.poly_id for r in points.point_in_polygon(spark.createDataFrame(pts, "id long, x double, y double"), df).collect()}
    assert got == want
    assert points.point_in_polygon(spark.createDataFrame(pts, "id long, x double, y double"), df.limit(0)).count() == 0


def test_hulls_of_parts_and_trees_by_brute_force(spark, sf_dir):
    from tessera.operators import kernels
    from tessera.plans import catalog  # noqa: F401
    from tessera.plans.registered import QUERIES, xy

    p = xy(spark, sf_dir).toPandas()
    tree = QUERIES["spanning_tree"](spark, sf_dir).toPandas()
    hulls = grouped.convex_hulls(xy(spark, sf_dir).repartition(7), "grp").toPandas()
    for g, part in p.groupby("grp"):
        c = part[["x", "y"]].to_numpy()
        d = np.hypot(*(c[:, None] - c[None, :]).transpose(2, 0, 1))
        root, total = list(range(len(c))), 0.0
        for k in np.argsort(d, axis=None):
            i, j = divmod(int(k), len(c))
            if root[i] != root[j]:
                total += d[i, j]
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
        own = tree[tree.grp == g]
        assert len(own) == len(c) - 1 and own.Dist.sum() == pytest.approx(total, abs=1e-3)
        assert np.array_equal(hulls[hulls.grp == g].sort_values("pnt_id")[["x", "y"]].to_numpy(), kernels.convex_hull(c))


def test_focal_cells_in_three_axes(spark):
    cells = spark.range(4 * 3 * 5).select((F.col("id") % 4).alias("a"), (F.floor(F.col("id") / 4) % 3).alias("b"), F.floor(F.col("id") / 12).alias("c"), F.col("id").cast("double").alias("value"))
    cube = np.arange(60, dtype=float).reshape(5, 3, 4)
    got = {(r.a, r.b, r.c): r.focal for r in windows.focal_cells(cells, {"a": 2, "b": 3, "c": 2}, F.sum("value"), {"c": 2}).collect()}
    assert got == {(a, 0, c): cube[c : c + 2, 0:3, a : a + 2].sum() for a in range(3) for c in (0, 2)}


def test_nearest_orders_no_rows_of_pairs(spark, monkeypatch):
    """What each point meets in the cells around it stays in lists: of all that is kept, only the least ids at a place are found by a window."""
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    plans, keep = [], points.materialise
    monkeypatch.setattr(points, "materialise", lambda d: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), keep(d))[1])
    got = {}
    for r in points.nearest(df, df, 2, exclude_same=True).collect():
        got.setdefault(r.id, []).append((r.n, r.id2, r.d))
    assert len(plans) > 1 and not any("Window" in p for p in plans[1:])
    assert {i: sorted(v) for i, v in got.items()} == brute(rows, rows, 2, True)
