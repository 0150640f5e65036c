"""Point operators: nearest neighbours, near tables, distance statistics, point-in-polygon, sorting.

Nearest neighbours are found through a grid: each place meets the places of its own and
the eight cells around it, and its answer is final once its k-th neighbour is no farther
than a cell's side. Places that are left go on with cells of twice the side, or more where
they meet few points, until the grid is one cell. The first side is that of the densest part, found by counting, so one
far point doesn't widen the others' cells; points at one place are one, of which no more
than the k + 1 least ids can be an answer. Squared distances are compared; the root is
taken of what is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.planar import contains_point, direction, distance, ring_extent, rotate, squared_distance
from tessera.plans.ordered import Ordered, materialise


def _cell(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(side)).cast("long")


def _least_ids(points: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """The ``most`` least ids at each place; first within ``parts`` of a place's rows, so no task has all rows of a hot place."""
    first = points.withColumn("__part", F.pmod(F.xxhash64("id2"), F.lit(parts)))
    first = first.withColumn("__r", F.row_number().over(Window.partitionBy("x2", "y2", "__part").orderBy("id2"))).where(F.col("__r") <= most)
    return first.withColumn("__r", F.row_number().over(Window.partitionBy("x2", "y2").orderBy("id2"))).where(F.col("__r") <= most).drop("__r", "__part")


def first_side(points: DataFrame, n: int, side: float, k: int, least: float) -> float:
    """A side at which no cell has many more than k points, if there is one of ``least`` or more: narrowed until the densest cell says so."""
    while side > least:
        most = points.groupBy(_cell(F.col("x2"), side), _cell(F.col("y2"), side)).count().agg(F.max("count")).first()[0]
        if most <= 8 * (k + 1):
            break
        # among the parts of the densest cell, one has its share at least
        side /= 2 ** max(1, int(math.log(most / (8 * (k + 1)), 4)))
    return side


def _met(places: DataFrame, points: DataFrame, side: float, wanted: int, most: int = 1024) -> DataFrame:
    """``x, y, near`` of the places with points around them: the ``wanted`` nearest of their own and the eight cells, by (d2, id2).

    A cell's row holds the points around it in a list, and a list of the nearest is taken where it meets a place,
    so pairs are never rows. Cells that no place asks for are left out; where cells of a wide side hold many points,
    all are dealt in lists of about ``most``, and each list's nearest are merged."""
    own = {"cx": _cell(F.col("x"), side), "cy": _cell(F.col("y"), side)}
    asking = places.withColumns(own)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    lent = points.withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
    lent = lent.select("id2", "x2", "y2", (_cell(F.col("x2"), side) + F.col("ox")).alias("cx"), (_cell(F.col("y2"), side) + F.col("oy")).alias("cy"))
    lent = lent.join(asking.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    densest = lent.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] or 1
    lists = math.ceil(densest / most)
    deal = F.pmod(F.xxhash64("id2", F.lit(11)), F.lit(lists)) if lists > 1 else F.lit(0)
    cells = materialise(lent.groupBy("cx", "cy", deal.alias("list")).agg(F.collect_list(F.struct("id2", "x2", "y2")).alias("all")))
    measured = F.transform("all", lambda q: F.struct(squared_distance(F.col("x"), F.col("y"), q["x2"], q["y2"]).alias("d2"), q["id2"].alias("id2"), q["x2"].alias("x2"), q["y2"].alias("y2")))
    near = asking.join(cells, ["cx", "cy"]).select("x", "y", F.slice(F.array_sort(measured), 1, wanted).alias("near"))
    if lists > 1:
        near = near.groupBy("x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, wanted).alias("near"))
    return materialise(near)


def _widening(places: DataFrame, points: DataFrame, side: float, budget: int) -> float:
    """The most of a few factors for the side at which places and the points of their own cells make no more pairs than ``budget``; 2 at least."""
    factors = [2.0, 4.0, 16.0, 256.0, 65536.0]

    def counted(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        at = df.withColumn("f", F.explode(F.array(*[F.lit(f) for f in factors])))
        return at.groupBy("f", F.floor(F.col(x) / (F.lit(side) * F.col("f"))).alias("cx"), F.floor(F.col(y) / (F.lit(side) * F.col("f"))).alias("cy")).agg(F.count(F.lit(1)).alias(name))

    met = counted(places, "x", "y", "a").join(counted(points, "x2", "y2", "b"), ["f", "cx", "cy"]).groupBy("f").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs")).collect()
    pairs = {r.f: r.pairs for r in met}
    return max(f for f in factors if f == 2.0 or pairs.get(f, 0) <= budget)


def nearest(origins: DataFrame, points: DataFrame, k: int, exclude_same: bool = False, side: float | None = None) -> DataFrame:
    """The k nearest ``points`` of each of ``origins`` (both id, x, y).

    Columns ``id, x, y, n`` (1 for the nearest), ``id2, x2, y2, d``; ties go to the
    smaller id; fewer rows where there are fewer points. ``exclude_same`` leaves out the
    point of the same id."""
    o = origins.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    wanted = k + 1 if exclude_same else k
    p = materialise(_least_ids(points.select(F.col("id").alias("id2"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2")), wanted))
    n, left, bottom, right, top = p.agg(F.count(F.lit(1)), F.min("x2"), F.min("y2"), F.max("x2"), F.max("y2")).first()
    o_box = o.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n or o_box[0] is None:
        return o.crossJoin(p.limit(0)).select("id", "x", "y", F.lit(1).alias("n"), "id2", "x2", "y2", F.lit(0.0).alias("d")).limit(0)
    whole = max(right - left, top - bottom, 1e-9)
    reach = max(right, o_box[2]) - min(left, o_box[0]) + max(top, o_box[3]) - min(bottom, o_box[1]) + whole
    side = side or first_side(p, n, whole * math.sqrt(max(k, 1) / n), wanted, whole * 2.0**-40)
    done: list[DataFrame] = []
    rest = o.select("x", "y").distinct()
    while True:
        last = side >= reach
        found = _met(rest, p, side, wanted)
        if last:
            done.append(found)
            break
        settled = F.when(F.size("near") == wanted, F.element_at("near", -1)["d2"] <= side * side).otherwise(False)
        done.append(found.where(settled))
        rest = materialise(rest.join(found.where(settled).select("x", "y"), ["x", "y"], "left_anti"))
        if rest.isEmpty():
            break
        side *= _widening(rest, p, side, n)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # every origin of a place has its answer, less itself
    out = o.join(out.select(F.col("x").alias("__x"), F.col("y").alias("__y"), "near"), (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")))
    if exclude_same:
        out = out.withColumn("near", F.slice(F.filter("near", lambda q: q["id2"] != F.col("id")), 1, k))
    out = out.select("id", "x", "y", F.posexplode("near").alias("n", "q"))
    return out.select("id", "x", "y", (F.col("n") + 1).alias("n"), "q.id2", "q.x2", "q.y2", F.sqrt("q.d2").alias("d"))


def distance_pairs(origins: DataFrame, destinations: DataFrame, within: float) -> DataFrame:
    """The distance table in long form, ``id, id2, d``, of all pairs at most ``within`` apart: cells of that side meet their neighbours only."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = origins.select("id", "x", "y").withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
    asked = asked.select("id", "x", "y", (_cell(F.col("x"), within) + F.col("ox")).alias("cx"), (_cell(F.col("y"), within) + F.col("oy")).alias("cy"))
    cells = destinations.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), _cell(F.col("x"), within).alias("cx"), _cell(F.col("y"), within).alias("cy"))
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    return asked.join(cells, ["cx", "cy"]).where(d2 <= within * within).select("id", "id2", F.sqrt(d2).alias("d"))


def nearest_wide(points: DataFrame, k: int) -> DataFrame:
    """One row for each point: ``ID`` its 0-based place by (x, y, id), ``Xo, Yo``, then ``C{i}_X, C{i}_Y, Dist{i}``."""
    order = Ordered(points.select("id", "x", "y"), ["x", "y", "id"]).with_number("ID0").df.select("id", (F.col("ID0") - 1).alias("ID0"))
    near = nearest(points, points, k, exclude_same=True)
    at = lambda i, c: F.max(F.when(F.col("n") == i + 1, F.col(c)))
    columns = [e for i in range(k) for e in (at(i, "x2").alias(f"C{i}_X"), at(i, "y2").alias(f"C{i}_Y"), at(i, "d").alias(f"Dist{i}"))]
    wide = near.groupBy("id").agg(F.first("x").alias("Xo"), F.first("y").alias("Yo"), *columns)
    return wide.join(order, "id").withColumn("ID", F.col("ID0")).select("ID", "Xo", "Yo", *[f"{a}{i}{b}" for i in range(k) for a, b in (("C", "_X"), ("C", "_Y"), ("Dist", ""))])


def nearest_destinations(origins: DataFrame, destinations: DataFrame, k: int) -> DataFrame:
    """Wide origin-destination table with ``Angle0``, degrees from the x axis to the nearest."""
    near = nearest(origins, destinations, k)
    at = lambda i, c: F.max(F.when(F.col("n") == i + 1, F.col(c)))
    columns = [e for i in range(k) for e in (at(i, "x2").alias(f"Dest{i}_X"), at(i, "y2").alias(f"Dest{i}_Y"), at(i, "d").alias(f"Dist{i}"))]
    wide = near.groupBy("id").agg(F.first("x").alias("Orig_X"), F.first("y").alias("Orig_Y"), *columns)
    return wide.withColumn("Angle0", direction(F.col("Orig_X"), F.col("Orig_Y"), F.col("Dest0_X"), F.col("Dest0_Y"))).withColumnRenamed("id", "ID")


def near_table(points: DataFrame, k: int = 1, other: DataFrame | None = None) -> DataFrame:
    """Long table of the k nearest of each origin, with the azimuth from north."""
    near = nearest(points, points if other is None else other, k, exclude_same=other is None)
    azimuth = direction(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), from_north=True)
    return near.select(F.col("id").alias("Orig"), F.col("id2").alias("Dest"), F.col("x").alias("X_orig"), F.col("y").alias("Y_orig"), F.col("x2").alias("X_dest"), F.col("y2").alias("Y_dest"), F.col("d").alias("OD_dist"), azimuth.alias("Azim_N"))


def near_table_wide(points: DataFrame, k: int = 1) -> DataFrame:
    """One row for each distinct point in (x, y) order: ``X_0, Y_0`` its own, ``X_i, Y_i`` and ``d_i`` of its i-th nearest."""
    wide = nearest_wide(points.groupBy("x", "y").agg(F.min("id").alias("id")), k)
    names = {"Xo": "X_0", "Yo": "Y_0"} | {f"C{i}_{c}": f"{c}_{i + 1}" for i in range(k) for c in "XY"} | {f"Dist{i}": f"d_{i + 1}" for i in range(k)}
    order = ["ID", *[f"{c}_{i}" for i in range(k + 1) for c in "XY"], *[f"d_{i + 1}" for i in range(k)]]
    return wide.withColumnsRenamed(names).select(*order)


def connect_nearest(points: DataFrame, k: int = 1) -> DataFrame:
    """Lines from each point to its k nearest: ends in (x, y) order, each undirected line once."""
    near = nearest(points, points, k, exclude_same=True)
    a, b = F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    ends = near.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.distinct().select(F.col("a.x").alias("X_from"), F.col("a.y").alias("Y_from"), F.col("b.x").alias("X_to"), F.col("b.y").alias("Y_to"))


def distance_statistics(points: DataFrame, group: str, block: int = 2048) -> DataFrame:
    """For each group: count, centre, extent, standard distance, and statistics of the pairwise distances
    that aren't zero (null where there is none). ``ID`` is the group's key.

    The pairs are never rows: a group's points are dealt to blocks of about ``block``, each
    pair of blocks is one task's kernel, and gives one row of partial moments. The least
    distance and the deviation are of all pairs, so the work is quadratic in a group's size."""
    p = points.select(F.col(group).alias("g"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    base = p.groupBy("g").agg(
        F.count(F.lit(1)).alias("N_pnts"), F.avg("x").alias("CentX"), F.avg("y").alias("CentY"), F.min("x").alias("MinX"), F.min("y").alias("MinY"), F.max("x").alias("MaxX"), F.max("y").alias("MaxY"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("Stand_Dist"),
    )
    blocks = base.select(F.struct("g").alias("key"), F.ceil(F.col("N_pnts") / block).alias("n"))
    dealt = p.join(blocks, F.struct("g") == F.col("key")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("n")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "own", "x", "y")
    kind = points.schema[group].dataType.simpleString()

    def moments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["own"].to_numpy() == key[1]
        xy = pdf[["x", "y"]].to_numpy()
        if key[1] == key[2]:
            i, j = np.triu_indices(len(xy), 1)
            d = np.hypot(*(xy[i] - xy[j]).T)
        else:
            d = np.hypot(*(xy[first][:, None] - xy[~first][None, :]).reshape(-1, 2).T)
        d = d[d > 0]
        some = d if len(d) else np.zeros(1)
        return pd.DataFrame({"g": pd.Series([key[0]], dtype=object), "n": [len(d)], "mean": [some.mean()], "m2": [((some - some.mean()) ** 2).sum()], "low": [some.min()], "high": [some.max()]})

    parts = dealt.groupBy("g", "b0", "b1").applyInPandas(moments, f"g {kind}, n long, mean double, m2 double, low double, high double").where("n > 0")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / n - mean * mean
    of_pairs = parts.groupBy("g").agg(mean.alias("Mean_dist"), F.min("low").alias("Min_dist"), F.max("high").alias("Max_dist"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("Std_dist"))
    of_pairs = of_pairs.select(F.struct("g").alias("key"), "Mean_dist", "Min_dist", "Max_dist", "Std_dist")
    return base.join(of_pairs, F.struct("g") == F.col("key"), "left").drop("key").withColumnRenamed("g", "ID")


def point_in_polygon(points: DataFrame, polygons: DataFrame, side: float | None = None) -> DataFrame:
    """For each point (id, x, y) strictly inside a polygon (``poly_id``, ``ring``): the smallest such ``poly_id``.

    Polygons are dealt to the grid cells that their extents touch, so points meet only
    the polygons near them; ``side`` defaults to the median extent. A polygon that is
    larger than that has cells of twice, four times, ... the side, so it touches four at
    most however large it is, and points are looked up once for each size that occurs."""
    boxes = polygons.withColumn("box", ring_extent(F.col("ring"))).where("box.L is not null")
    boxes = boxes.withColumn("__size", F.greatest(F.col("box.R") - F.col("box.L"), F.col("box.T") - F.col("box.B")))
    if side is None:
        side = boxes.agg(F.percentile_approx("__size", 0.5)).first()[0] or 1.0
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("__size"), F.lit(side)) / side)), F.lit(0)).cast("int")
    boxes = boxes.withColumn("__level", level)
    levels = [r[0] for r in boxes.select("__level").distinct().collect()]
    if not levels:
        return points.select("id", F.lit(None).cast(polygons.schema["poly_id"].dataType).alias("poly_id")).limit(0)
    cell = lambda v, at: F.floor(v / (F.lit(side) * F.pow(F.lit(2.0), at))).cast("long")
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), F.col("__level")), cell(F.col(b), F.col("__level"))))
    dealt = boxes.withColumn("cx", span("box.L", "box.R")).withColumn("cy", span("box.B", "box.T"))
    asked = points.select("id", "x", "y", F.explode(F.array(*[F.lit(v) for v in levels])).alias("__level"))
    cells = asked.withColumns({"cx": cell(F.col("x"), F.col("__level")), "cy": cell(F.col("y"), F.col("__level"))})
    met = cells.join(dealt, ["__level", "cx", "cy"]).where(F.col("x").between(F.col("box.L"), F.col("box.R")) & F.col("y").between(F.col("box.B"), F.col("box.T")))
    return met.where(contains_point(F.col("ring"), F.col("x"), F.col("y"))).groupBy("id").agg(F.min("poly_id").alias("poly_id"))


def radial_sort(points: DataFrame, center: tuple[float, float] | None = None) -> DataFrame:
    """By angle about the centre (the mean if not given): ``IDcent`` from 0, ``Xp, Yp, Angle_, Dist_, Orig_ID``."""
    if center is None:
        points = points.crossJoin(F.broadcast(points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))))
    else:
        points = points.withColumns({"cx": F.lit(float(center[0])), "cy": F.lit(float(center[1]))})
    angle = direction(F.col("cx"), F.col("cy"), F.col("x"), F.col("y"))
    rows = points.select(F.col("x").alias("Xp"), F.col("y").alias("Yp"), angle.alias("Angle_"), distance(F.col("cx"), F.col("cy"), F.col("x"), F.col("y")).alias("Dist_"), F.col("id").alias("Orig_ID"))
    return Ordered(rows, ["Angle_", "Dist_", "Orig_ID"]).with_number("IDcent").df.withColumn("IDcent", F.col("IDcent") - 1)


def rotate_points(points: DataFrame, degrees: float) -> DataFrame:
    """Clockwise about the mean of the distinct points; every row stays in place."""
    center = points.select("x", "y").distinct().agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    rows = points.crossJoin(F.broadcast(center))
    x, y = rotate(F.col("x"), F.col("y"), degrees, F.col("__cx"), F.col("__cy"), clockwise=True)
    return rows.withColumns({"x": x, "y": y}).drop("__cx", "__cy")


def sort_points(points: DataFrame, by: str = "X", ascending: bool = True, out: str = "place") -> DataFrame:
    """Adds the 1-based place by (x, y) or (y, x), falling if not ``ascending``."""
    keys = ["x", "y"] if by.upper() == "X" else ["y", "x"]
    numbered = Ordered(points, [*keys, "id"]).with_number(out).df
    if ascending:
        return numbered
    return numbered.crossJoin(F.broadcast(points.agg(F.count(F.lit(1)).alias("__n")))).withColumn(out, F.col("__n") + 1 - F.col(out)).drop("__n")
