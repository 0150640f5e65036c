"""Queries of the expressions on text, coordinates, points and rings, with the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates, planar, text
from tessera.operators import grouped, points, shapes, tables, windows
from tessera.plans.catalog import HULL, squares
from tessera.plans.registered import XY, query, rounded, table, xy

_SQUARES = "s AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS h FROM part)"


# calculator


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1.0) AS filled FROM customer")
def replace_null(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return c.select("c_custkey", text.replace_null("v", -1.0).alias("filled"))


@query("SELECT p_partkey, p_size >= 25 AS at_least FROM part")
def greater_than(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.at_least("p_size", 25).alias("at_least"))


@query("SELECT p_partkey, p_size <= 25 AS at_most FROM part")
def less_than(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.at_most("p_size", 25).alias("at_most"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def if_elif_else(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", text.if_elif_else([(size < 10, "small"), (size < 30, "medium")], "large").alias("class"))


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS missing FROM customer")
def null_test(spark, sf_dir):
    k = F.col("c_custkey") % 3
    c = table(spark, sf_dir, "customer").withColumn("v", F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.col("c_acctbal")))
    return c.select("c_custkey", tables.has_nulls("v").alias("missing"))


@query("SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 2 = 1 THEN p_type END, CASE WHEN p_size % 3 > 0 THEN p_brand END, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS VARCHAR) END) AS joined FROM part")
def join_non_null(spark, sf_dir):
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 2 == 1, F.col("p_type")).alias("a"), F.when(size % 3 > 0, F.col("p_brand")).otherwise("").alias("b"), (size % 5).alias("c"))
    return p.select("p_partkey", text.join_non_null(["a", "b", "c"]).alias("joined"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN p_type || ' ' ELSE '' END || p_brand || ' ' AS joined FROM part")
def join_non_null_mini(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("a", F.when(F.col("p_size") % 2 == 1, F.col("p_type")))
    return p.select("p_partkey", text.join_non_null(["a", "p_brand"], trailing=True).alias("joined"))


@query(r"""SELECT c_custkey, regexp_replace(c_name, '[!"#$%&''()*+,./:;<=>?@\[\\\]^`{|}~ -]', '_', 'g') AS clean FROM customer""")
def de_punctuate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.de_punctuate("c_name").alias("clean"))


@query("SELECT o_orderkey, CAST(nullif(regexp_extract(k, '^[0-9]+', 0), '') AS BIGINT) AS digits FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR) || '-' || o_orderstatus AS k FROM orders)")
def leading_digits(spark, sf_dir):
    k = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(""), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.leading_int(k).alias("digits"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS collapsed FROM documents")
def collapse_spaces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_spaces("text").alias("collapsed"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+'), lambda w: regexp_matches(w, '^[0-9]+$')), ', ') AS numbers FROM documents")
def numbers_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.numbers_list("text").alias("numbers"))


@query("SELECT k, row_number() OVER (ORDER BY c_custkey) AS place FROM (SELECT c_custkey, 'n' || CAST(c_custkey AS VARCHAR) AS k FROM customer)")
def natural_sort(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("k"))
    return windows.rank_ordinal(c.withColumn("key", text.natural_key("k")), ["key"], ["k"], "place").drop("key")


_DMS = "p AS (SELECT c_custkey, v, round(abs(v) * 3600, 6) AS t FROM (SELECT c_custkey, c_acctbal / 100 AS v FROM customer))"
_D, _M = "CAST(floor(t / 3600) AS INT)", "CAST(floor((t % 3600) / 60) AS INT)"


@query(f"WITH {_DMS} SELECT c_custkey, CASE WHEN v < 0 THEN '-' ELSE ' ' END || printf('%03d', {_D}) || '° ' || printf('%02d', {_M}) || chr(39) || ' ' || printf('%07.4f', t % 60) || chr(34) AS shown FROM p")
def degrees_minutes_seconds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", dates.to_dms_symbols(F.col("c_acctbal") / 100).alias("shown"))


@query(f"""WITH {_DMS}, d AS (SELECT c_custkey, v, {_D} AS d, {_M} AS m, printf('%05.2f', t % 60) AS s FROM p)
SELECT c_custkey, printf('%d-%d-', d, m) || s || CASE WHEN v < 0 THEN 'S' ELSE 'N' END AS shown, CASE WHEN v < 0 THEN '-' ELSE '' END || printf('%d-%d-', d, m) || s AS signed FROM d""")
def degrees_dashed(spark, sf_dir):
    v = F.col("c_acctbal") / 100
    return table(spark, sf_dir, "customer").select("c_custkey", dates.to_dms(v, longitude=False).alias("shown"), dates.to_dms(v, use_sign=True, use_quad=False).alias("signed"))


@query("SELECT c_custkey, printf('%d %.2f', CAST(floor(abs(v)) AS INT), (abs(v) - floor(abs(v))) * 60) || chr(39) || ' ' || CASE WHEN v < 0 THEN 'W' ELSE 'E' END AS shown FROM (SELECT c_custkey, c_acctbal / 97 AS v FROM customer)")
def degrees_decimal_minutes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", dates.to_dmm(F.col("c_acctbal") / 97).alias("shown"))


@query("SELECT c_custkey, round(c_custkey % 90 + 1 + (c_custkey % 600) / 10.0 / 60, 8) AS degrees FROM customer")
def from_decimal_minutes(spark, sf_dir):
    k = F.col("c_custkey")
    shown = F.concat((k % 90 + 1).cast("string"), F.lit(" "), F.format_string("%.1f", (k % 600) / 10.0))
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", dates.from_text(shown).alias("degrees")), 8)


# planar expressions


@query("SELECT count(*) AS n, true AS floats, true AS ints, true AS jittered FROM customer")
def random_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(planar.jitter(F.lit(10.0), -2.0, 3.0, 1).alias("f"), planar.random_int(3, 9, 2).alias("i"), planar.jitter(F.col("c_acctbal"), seed=4).alias("j"), "c_acctbal")
    return c.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("f").between(8.0, 13.0)).alias("floats"), F.bool_and(F.col("i").between(3, 8)).alias("ints"), F.bool_and(F.abs(F.col("j") - F.col("c_acctbal")) <= 1.0).alias("jittered"))


@query(f"""WITH {XY}, t AS (SELECT id, atan2(y - 0.5, x - 1.0) - 0.25 AS a FROM xy) SELECT id, round(a - 2 * pi() * floor(a / (2 * pi())) - pi(), 6) AS turn FROM t""")
def turn_angle(spark, sf_dir):
    return rounded(xy(spark, sf_dir).select("id", planar.turn_angle(F.col("x"), F.col("y"), F.lit(1.0), F.lit(0.5), F.lit(0.25)).alias("turn")))


_PAIRS = f"""{XY}, p AS (SELECT id, x, y, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(x, 3) OVER w AS x3, lead(y, 3) OVER w AS y3 FROM xy WINDOW w AS (PARTITION BY grp ORDER BY id))"""


def _segments(spark, sf_dir) -> DataFrame:
    """Two segments for each row: from it to the next of its group, and from the one after to the next again."""
    w = Window.partitionBy("grp").orderBy("id")
    p = xy(spark, sf_dir)
    return p.select("id", "x", "y", *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2, 3) for c in "xy"]).where("x3 is not null")


def _ends() -> list[tuple[Column, Column]]:
    return [(F.col(f"x{k}"), F.col(f"y{k}")) for k in ("", 1, 2, 3)]


@query(f"""WITH {_PAIRS}, s AS (SELECT *, (x1 - x) * (y2 - y) - (y1 - y) * (x2 - x) AS a, (x1 - x) * (y3 - y) - (y1 - y) * (x3 - x) AS b, (x3 - x2) * (y - y2) - (y3 - y2) * (x - x2) AS c, (x3 - x2) * (y1 - y2) - (y3 - y2) * (x1 - x2) AS d FROM p WHERE x3 IS NOT NULL)
SELECT id, a * b < 0 AND c * d < 0 AS crosses FROM s""")
def segment_intersection(spark, sf_dir):
    return _segments(spark, sf_dir).select("id", planar.segments_cross(*_ends()).alias("crosses"))


@query(f"""WITH {_PAIRS}, s AS (SELECT *, ((x2 - x) * (y3 - y2) - (y2 - y) * (x3 - x2)) / ((x1 - x) * (y3 - y2) - (y1 - y) * (x3 - x2)) AS t FROM p WHERE x3 IS NOT NULL AND abs((x1 - x) * (y3 - y2) - (y1 - y) * (x3 - x2)) > 0.05)
SELECT id, round(x + t * (x1 - x), 4) AS x, round(y + t * (y1 - y), 4) AS y FROM s""")
def line_intersection(spark, sf_dir):
    s = _segments(spark, sf_dir).where("abs((x1 - x) * (y3 - y2) - (y1 - y) * (x3 - x2)) > 0.05")
    at = planar.line_intersection(*_ends())
    return rounded(s.select("id", at["x"].alias("x"), at["y"].alias("y")), 4)


@query(f"""WITH {XY} SELECT a.id, EXISTS (SELECT 1 FROM xy b WHERE b.id IN (3, 7) AND abs(b.x - a.x) <= 1e-8 AND abs(b.y - a.y) <= 1e-8) AS listed FROM xy a""")
def point_in_list(spark, sf_dir):
    p = xy(spark, sf_dir)
    listed = p.where("id in (3, 7)").agg(F.collect_list(planar.point("x", "y")).alias("list"))
    return p.crossJoin(F.broadcast(listed)).select("id", planar.point_in_list(F.col("x"), F.col("y"), F.col("list")).alias("listed"))


@query(f"WITH {XY} SELECT id, x, y FROM xy")
def point_column(spark, sf_dir):
    return xy(spark, sf_dir).select("id", planar.point("x", "y").alias("p")).select("id", "p.x", "p.y")


@query(f"WITH {XY} SELECT id, x > -0.5 AND x < 0.5 AND y > -0.5 AND y < 0.5 AS inside FROM xy")
def point_in_ring(spark, sf_dir):
    box = F.struct(F.lit(-0.5).alias("L"), F.lit(-0.5).alias("B"), F.lit(0.5).alias("R"), F.lit(0.5).alias("T"))
    return xy(spark, sf_dir).select("id", planar.contains_point(planar.extent_ring(box), F.col("x"), F.col("y")).alias("inside"))


def _two_parts(df: DataFrame) -> Column:
    """The ring, and a copy 1000 to its right."""
    return F.array(F.col("ring"), F.transform("ring", lambda p: F.struct((p["x"] + 1000).alias("x"), p["y"].alias("y"))))


@query(f"WITH {_SQUARES} SELECT id, CAST(2 AS INT) AS parts, CAST(8 AS INT) AS points FROM s")
def part_counts(spark, sf_dir):
    parts = _two_parts(squares(spark, sf_dir))
    return squares(spark, sf_dir).select("id", planar.count_parts(parts).alias("parts"), planar.count_points(parts).alias("points"))


@query(f"WITH {_SQUARES} SELECT id, CAST(k AS INT) AS part_id, round(w * h, 6) AS area FROM s, range(2) t(k)")
def single_parts(spark, sf_dir):
    s = squares(spark, sf_dir)
    return rounded(shapes.single_parts(s.select("id", _two_parts(s).alias("parts"))).select("id", "part_id", planar.ring_area(F.col("ring")).alias("area")))


@query(f"WITH {_SQUARES} SELECT id, CASE WHEN k IN (2, 3) THEN w ELSE 0.0 END AS x, CASE WHEN k IN (1, 2) THEN round(h, 6) ELSE 0.0 END AS y FROM s, range(5) t(k)")
def flatten_parts(spark, sf_dir):
    nested = squares(spark, sf_dir).select("id", F.array(F.slice("ring", 1, 2), F.slice("ring", 3, 3)).alias("parts"))
    return rounded(shapes.vertices(nested.select("id", F.flatten("parts").alias("ring"))).select("id", "x", "y"))


@query(f"WITH {_SQUARES} SELECT id, round(sum(2 * (w + h)) OVER (ORDER BY id), 4) AS cumulative FROM s")
def cumulative_length(spark, sf_dir):
    lengths = squares(spark, sf_dir).select("id", planar.ring_length(F.col("ring")).alias("length"))
    return rounded(windows.cumulative_sum(lengths, "length", ["id"], "cumulative").select("id", "cumulative"), 4)


@query("""SELECT CAST(k AS INT) AS pnt_id, round(5 * cos(radians(180 - 60 * k)), 6) + 0.0 AS x, round(5 * sin(radians(180 - 60 * k)), 6) + 0.0 AS y FROM range(7) t(k)""")
def n_gon(spark, sf_dir):
    return rounded(shapes.vertices(spark.range(1).select(shapes.n_gon(6, 5.0).alias("ring"))))


@query("""WITH RECURSIVE s(k, r, c, d, top, bottom, lft, rgt) AS (
  SELECT 0, 0, 0, 0, 1, 5, 0, 6
  UNION ALL SELECT k + 1, r + CASE e WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END, c + CASE e WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END, e,
    top + CASE WHEN e <> d AND e = 0 THEN 1 ELSE 0 END, bottom - CASE WHEN e <> d AND e = 2 THEN 1 ELSE 0 END, lft + CASE WHEN e <> d AND e = 3 THEN 1 ELSE 0 END, rgt - CASE WHEN e <> d AND e = 1 THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN d = 0 AND c = rgt THEN 1 WHEN d = 1 AND r = bottom THEN 2 WHEN d = 2 AND c = lft THEN 3 WHEN d = 3 AND r = top THEN 0 ELSE d END AS e FROM s) WHERE k < 41)
SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, CAST(k AS BIGINT) AS place FROM s""")
def spiral_order(spark, sf_dir):
    g = spark.range(42).select(F.floor(F.col("id") / 7).alias("row"), (F.col("id") % 7).alias("col"))
    return g.select("row", "col", shapes.spiral_order(F.lit(6), F.lit(7), F.col("row"), F.col("col")).alias("place"))


@query(f"""WITH {XY}, a AS (SELECT avg(x) AS cx, avg(y) AS cy, greatest(max(x) - min(x), max(y) - min(y)) AS size FROM xy)
SELECT CAST(k AS INT) AS pnt_id, round(cx + 10 * size * cos(radians(180 - 10 * k)), 6) AS x, round(cy + 10 * size * sin(radians(180 - 10 * k)), 6) AS y FROM a, range(37) t(k)""")
def infinity_circle(spark, sf_dir):
    return rounded(shapes.infinity_circle(xy(spark, sf_dir)))


def _part_areas(parts: DataFrame) -> DataFrame:
    return rounded(parts.select("id", "part", planar.ring_area(F.col("ring")).alias("area")), 9)


@query(f"WITH {_SQUARES} SELECT id, CAST(k AS INT) AS part, round(w * h / 3, 6) AS area FROM s, range(3) t(k)")
def split_equal_area(spark, sf_dir):
    return rounded(_part_areas(grouped.split_rings(squares(spark, sf_dir), "id", "area", 3)))


@query(f"WITH {_SQUARES} SELECT id, CAST(k AS INT) AS part, round(w * (least(h, (k + 1) * 4) - k * 4), 6) AS area FROM s, range(30) t(k) WHERE k * 4 < h - 1e-9")
def split_by_distance(spark, sf_dir):
    return rounded(_part_areas(grouped.split_rings(squares(spark, sf_dir), "id", "distance", 4.0, "Y")))


@query(f"WITH {HULL} SELECT grp AS id, CAST(4 AS INT) AS wedges, round(area, 4) AS area, true AS alike FROM hull")
def split_sector(spark, sf_dir):
    """Each group's hull in four wedges: their number, total area, and whether each is near its share."""
    hulls = shapes.rings(grouped.convex_hulls(xy(spark, sf_dir), "grp"), "grp").withColumnRenamed("grp", "id")
    rings = shapes.rings(grouped.split_by_sector(hulls, "id", 4).withColumn("key", F.struct("id", "part")), "key")
    pieces = _part_areas(rings.select("key.id", "key.part", "ring"))
    sizes = pieces.groupBy("id", F.floor(F.col("part") / 100_000).alias("wedge")).agg(F.sum("area").alias("a"))
    whole = sizes.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("wedges"), F.sum("a").alias("area"), F.min("a").alias("least"), F.max("a").alias("most"))
    return rounded(whole.select("id", "wedges", "area", ((F.col("least") > 0.9 * F.col("area") / 4) & (F.col("most") < 1.1 * F.col("area") / 4)).alias("alike")), 4)


@query(f"WITH {_SQUARES} SELECT id, round(w * 6378.137 * {math.pi / 180!r}, 3) AS along_km FROM s")
def geodesic_equator(spark, sf_dir):
    """Along the equator the geodesic is an arc of the equatorial circle."""
    g = squares(spark, sf_dir).withColumn("g", grouped.geodesic(F.lit(0.0), F.lit(0.0), F.col("w"), F.lit(0.0)))
    return rounded(g.select("id", (F.col("g.Distance_m") / 1000).alias("along_km")), 3)


# points and groups


@query(f"WITH {XY} SELECT id, round(sqrt(pow(x - 0.25, 2) + pow(y + 0.5, 2)), 6) AS d FROM xy ORDER BY pow(x - 0.25, 2) + pow(y + 0.5, 2), id LIMIT 5")
def nearest_in_list(spark, sf_dir):
    origin = spark.createDataFrame([(0, 0.25, -0.5)], "id long, x double, y double")
    return rounded(points.nearest(origin, xy(spark, sf_dir), 5).select(F.col("id2").alias("id"), "d"))


@query(f"""WITH {XY}, n AS (SELECT a.id, b.id AS id2, row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS n FROM xy a JOIN xy b ON a.id <> b.id) SELECT id AS "ID", id2 AS "Closest" FROM n WHERE n = 1""")
def nearest_id(spark, sf_dir):
    p = xy(spark, sf_dir)
    return points.nearest(p, p, 1, exclude_same=True).select(F.col("id").alias("ID"), F.col("id2").alias("Closest"))


@query(f"""WITH {XY}, g AS (SELECT r * 8 + c AS poly_id, -3 + c * 0.75 AS l, -3 + r * 0.75 AS b FROM range(8) t(r), range(8) u(c)), m AS (SELECT id, min(poly_id) AS poly_id FROM xy, g WHERE x > l AND x < l + 0.75 AND y > b AND y < b + 0.75 GROUP BY id)
SELECT poly_id, count(*) AS n, min(id) AS first_id FROM m GROUP BY 1""")
def point_groups(spark, sf_dir):
    grid = shapes.sampling_grid(spark, "rectangle", -3, -3, 0.75, 0.75, 8, 8).select(F.col("cell").alias("poly_id"), "ring")
    return points.point_in_polygon(xy(spark, sf_dir), grid).groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {XY} SELECT id FROM xy WHERE x > -1 AND x < 1 AND y > -0.5 AND y < 0.5")
def spatial_select(spark, sf_dir):
    p = xy(spark, sf_dir)
    box = F.struct(F.lit(-1.0).alias("L"), F.lit(-0.5).alias("B"), F.lit(1.0).alias("R"), F.lit(0.5).alias("T"))
    return p.join(points.point_in_polygon(p, spark.range(1).select(F.col("id").alias("poly_id"), planar.extent_ring(box).alias("ring"))), "id", "left_semi").select("id")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, round((pow(a - m, 4) + pow(b - m, 4) + pow(c - m, 4)) / 3 / pow((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3, 2), 6) AS kurt
FROM (SELECT *, (a + b + c) / 3 AS m FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem))""")
def row_kurtosis(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), tables.row_skew_kurt(["l_quantity", "l_discount", "l_tax"], "kurt").alias("kurt")))
