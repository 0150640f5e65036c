"""Queries of the library's operators over the driver's tables, by name, with the same in SQL.

Floating results are rounded in both, since the engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dates, planar, registry, text
from tessera.operators import grouped, points, shapes, tables, windows
from tessera.plans.registered import XY, query, rounded, table, xy
from tessera.sources import features

# tables


@query("""SELECT l_returnflag, l_linestatus, count(*) AS "Counts" FROM lineitem GROUP BY 1, 2""")
def frequency(spark, sf_dir):
    return tables.frequency(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS "Counts", round(coalesce(sum(l_quantity), 0.0), 6) AS l_quantity_sums, count(*) FILTER (l_quantity IS NULL) AS "l_quantity_NaN", min(l_quantity) AS l_quantity_min, round(avg(l_quantity), 6) AS l_quantity_mean, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY 1, 2""")
def frequency_stats(spark, sf_dir):
    return rounded(tables.frequency(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS "Count" FROM orders GROUP BY 1, 2""")
def crosstab_long(spark, sf_dir):
    return tables.crosstab_long(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS "Total" FROM orders GROUP BY 1""")
def crosstab_dense(spark, sf_dir):
    return tables.crosstab_dense(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS "Count", CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def crosstab_totals(spark, sf_dir):
    return tables.crosstab_totals(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


STAT_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MOMENTS = " UNION ALL ".join(
    f"""SELECT '{f}' AS "Field", count(v) AS "N", round(sum(v), 4) AS "Sum", round(min(v), 4) AS "Min", round(max(v), 4) AS "Max", round(median(v), 4) AS "Med", round(avg(v), 4) AS "Avg", round(stddev_pop(v), 4) AS "Std", round(var_pop(v), 4) AS "Var",
    round(avg((v - m) * (v - m) * (v - m)) / pow(var_pop(v), 1.5), 4) AS "Skew", round(avg((v - m) * (v - m) * (v - m) * (v - m)) / pow(var_pop(v), 2), 4) AS "Kurt" FROM (SELECT {f} AS v, avg({f}) OVER () AS m FROM lineitem)"""
    for f in STAT_FIELDS
)


@query(_MOMENTS)
def field_statistics(spark, sf_dir):
    return rounded(tables.field_statistics(table(spark, sf_dir, "lineitem"), STAT_FIELDS), 4)


@query("""SELECT name, type, nullable, position FROM (VALUES (0, 'n_nationkey', 'int', true), (1, 'n_name', 'string', true), (2, 'n_regionkey', 'int', true)) t(position, name, type, nullable)""")
def field_info(spark, sf_dir):
    return tables.field_info(table(spark, sf_dir, "nation"))


@query("""SELECT c_custkey, round(skew, 6) AS skew FROM (SELECT l_orderkey * 10 + l_linenumber AS c_custkey, (pow(a - m, 3) + pow(b - m, 3) + pow(c - m, 3)) / 3 / pow((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3, 1.5) AS skew
FROM (SELECT *, (a + b + c) / 3 AS m FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem)))""")
def row_skewness(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return rounded(l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("c_custkey"), tables.row_skew_kurt(["l_quantity", "l_discount", "l_tax"]).alias("skew")))


@query("""SELECT c_mktsegment, round(exp(avg(ln(abs(c_acctbal) + 1))), 6) AS gmean FROM customer GROUP BY 1""")
def geometric_mean(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("v", F.abs("c_acctbal") + 1)
    return rounded(c.groupBy("c_mktsegment").agg(tables.geometric_mean("v").alias("gmean")))


@query(f"""WITH {XY} SELECT min(x) AS "L", min(y) AS "B", max(x) AS "R", max(y) AS "T" FROM xy""")
def extent(spark, sf_dir):
    return xy(spark, sf_dir).agg(*tables.extent())


@query(f"""WITH {XY} SELECT grp, round(avg(x), 6) AS "CentX", round(avg(y), 6) AS "CentY" FROM (SELECT DISTINCT grp, x, y FROM xy) GROUP BY grp""")
def mean_center(spark, sf_dir):
    return rounded(tables.mean_center(xy(spark, sf_dir), ["grp"]))


@query("""SELECT CAST(bin AS INT) AS bin, count(*) AS "Count" FROM (SELECT CASE WHEN p_retailprice < 920 THEN 0 WHEN p_retailprice < 950 THEN 1 WHEN p_retailprice < 980 THEN 2 ELSE 3 END AS bin FROM part WHERE p_retailprice BETWEEN 0 AND 1e9) GROUP BY 1""")
def histogram(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "part"), "p_retailprice", [0, 920, 950, 980, 1e9])


@query("""SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def extend_table(spark, sf_dir):
    return tables.extend_table(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "n_regionkey", "r_regionkey")


@query("""WITH h AS (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)
SELECT 'r_regionkey' AS field, max(CASE WHEN r_regionkey = 0 THEN CAST(r_regionkey AS VARCHAR) END) AS r0, max(CASE WHEN r_regionkey = 1 THEN CAST(r_regionkey AS VARCHAR) END) AS r1, max(CASE WHEN r_regionkey = 2 THEN CAST(r_regionkey AS VARCHAR) END) AS r2 FROM h
UNION ALL SELECT 'r_name', max(CASE WHEN r_regionkey = 0 THEN r_name END), max(CASE WHEN r_regionkey = 1 THEN r_name END), max(CASE WHEN r_regionkey = 2 THEN r_name END) FROM h""")
def transpose_head(spark, sf_dir):
    return tables.transpose_head(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"], 3)


# windows


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("""SELECT c_custkey, c_acctbal, CAST(rank() OVER (ORDER BY c_acctbal) - 1 AS BIGINT) AS "Rank" FROM customer""")
def rank_min(spark, sf_dir):
    return windows.rank_min(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS "Rank" FROM customer""")
def rank_ordinal(spark, sf_dir):
    return windows.rank_ordinal(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], ["c_custkey"]).drop("c_acctbal")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey) AS "Rank" FROM customer""")
def rank_multi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return windows.rank_ordinal(c, ["c_mktsegment", "c_nationkey"], ["c_custkey"]).select("c_custkey", "Rank")


@query("""SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS cumsum FROM events""")
def cumulative_sum(spark, sf_dir):
    return rounded(windows.cumulative_sum(events(spark, sf_dir), "value", ["event_id"]).select("event_id", "cumsum"), 4)


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id), 4) AS cumsum FROM events""")
def cumulative_sum_by_type(spark, sf_dir):
    return rounded(windows.cumulative_sum(events(spark, sf_dir), "value", ["event_id"], partition_by=["event_type"]).select("event_id", "cumsum"), 4)


def _difference(statistic: str, sql: str) -> None:
    def run(spark, sf_dir):
        return rounded(windows.difference_from(events(spark, sf_dir), "value", statistic).select("event_id", "diff"))

    run.__name__ = f"{statistic}_diff"
    query(f"SELECT event_id, round(value - (SELECT {sql} FROM events), 6) AS diff FROM events")(run)


for _name, _sql in (("max", "max(value)"), ("mean", "avg(value)"), ("median", "median(value)"), ("min", "min(value)")):
    _difference(_name, _sql)


@query("""SELECT event_id, round(value - 2.5, 6) AS diff FROM events""")
def value_diff(spark, sf_dir):
    return rounded(windows.difference_from(events(spark, sf_dir), "value", 2.5).select("event_id", "diff"))


@query("""SELECT event_id, round(100 * value / (SELECT sum(value) FROM events), 8) AS percent FROM events""")
def percent(spark, sf_dir):
    return rounded(windows.percent(events(spark, sf_dir), "value").select("event_id", "percent"), 8)


@query("""SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z FROM events""")
def z_score(spark, sf_dir):
    return rounded(windows.z_score(events(spark, sf_dir), "value").select("event_id", "z"))


@query("""SELECT event_id, round(coalesce(value - lag(value) OVER (ORDER BY event_id), 0.0), 6) AS diff FROM events""")
def sequential_difference(spark, sf_dir):
    return rounded(windows.sequential_difference(events(spark, sf_dir), "value", ["event_id"]).select("event_id", "diff"))


_K = "row_number() OVER (PARTITION BY event_type ORDER BY event_id)"


@query(f"""SELECT event_id, event_type || CASE WHEN length(CAST(k AS VARCHAR)) < 2 THEN lpad(CAST(k AS VARCHAR), 2, '0') ELSE CAST(k AS VARCHAR) END AS label FROM (SELECT event_id, event_type, {_K} - 1 AS k FROM events)""")
def sequential_number(spark, sf_dir):
    return windows.sequential_text(events(spark, sf_dir), "event_type", ["event_id"], style="number").select("event_id", "label")


@query(f"""WITH w AS (SELECT length(CAST(max(n) AS VARCHAR)) AS width FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) SELECT event_id, event_type || '_' || lpad(CAST(k AS VARCHAR), CAST(width AS INT), '0') AS label FROM (SELECT event_id, event_type, {_K} - 1 AS k FROM events), w""")
def sequential_text(spark, sf_dir):
    return windows.sequential_text(events(spark, sf_dir), "event_type", ["event_id"]).select("event_id", "label")


@query(f"""SELECT event_id, event_type || '_' || CASE WHEN length(CAST(k AS VARCHAR)) < 3 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS label FROM (SELECT event_id, event_type, {_K} AS k FROM events)""")
def running_count(spark, sf_dir):
    return windows.sequential_text(events(spark, sf_dir), "event_type", ["event_id"], style="count").select("event_id", "label")


@query("""SELECT event_id, CAST(event_type IS NOT DISTINCT FROM lag(event_type, 1, '') OVER (ORDER BY event_id) AS INT) AS dup FROM events""")
def sequential_duplicate(spark, sf_dir):
    return windows.sequential_duplicate(events(spark, sf_dir), "event_type", ["event_id"]).select("event_id", "dup")


@query("""SELECT event_id, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS "group" FROM events""")
def sequence_group(spark, sf_dir):
    return windows.sequence_group(events(spark, sf_dir), "event_id", 7, ["event_id"]).select("event_id", "group")


_RUNS = """WITH n AS (SELECT {v} AS v, row_number() OVER (ORDER BY event_id) AS n, lag({v}) OVER (ORDER BY event_id) AS p FROM events),
r AS (SELECT *, sum(CASE WHEN n = 1 OR NOT ({on}) THEN 1 ELSE 0 END) OVER (ORDER BY n) AS run FROM n)
SELECT CAST(run - 1 AS BIGINT) AS "ID", arg_min(v, n) AS "Value", count(*) AS "Count", min(n) - 1 AS "From_", max(n) AS "To_" FROM r GROUP BY run"""


@query(_RUNS.format(v="event_type", on="v = p"))
def run_lengths(spark, sf_dir):
    return windows.run_lengths(events(spark, sf_dir), "event_type", ["event_id"])


@query(_RUNS.format(v="user_id % 5", on="v - p = 1"))
def run_lengths_step(spark, sf_dir):
    return windows.run_lengths(events(spark, sf_dir).withColumn("v", F.col("user_id") % 5), "v", ["event_id"], step=1)


def _moving(func: str, sql: str, digits: int = 6) -> None:
    def run(spark, sf_dir):
        e = events(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 20)) if func in ("mode", "trend") else events(spark, sf_dir).withColumn("v", F.col("value"))
        return rounded(windows.moving_window(e, "v", ["event_id"], func, 5).select("event_id", "moved"), digits)

    run.__name__ = f"moving_{func}"
    query(sql)(run)


for _f, _agg in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("sum", "sum")):
    _moving(_f, f"SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN round({_agg}(value) OVER w, 6) END AS moved FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
_moving(
    "mode",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, CAST(floor(value / 20) AS DOUBLE) AS v FROM events),
p AS (SELECT a.event_id, a.n, b.v, count(*) AS c FROM n a JOIN n b ON b.n BETWEEN a.n - 2 AND a.n + 2 GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, v) AS k FROM p)
SELECT event_id, CASE WHEN n > 2 AND n <= (SELECT max(n) FROM n) - 2 THEN v END AS moved FROM q WHERE k = 1""",
)
_moving(
    "trend",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, sign(CAST(floor(value / 20) AS DOUBLE) - lag(CAST(floor(value / 20) AS DOUBLE)) OVER (ORDER BY event_id)) AS v FROM events),
p AS (SELECT a.event_id, a.n, b.v, count(*) AS c FROM n a JOIN n b ON b.n BETWEEN a.n - 1 AND a.n + 2 AND b.v IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, v) AS k FROM p)
SELECT event_id, CASE WHEN n > 2 AND n <= (SELECT max(n) FROM n) - 2 THEN CAST(v AS DOUBLE) END AS moved FROM q WHERE k = 1""",
)


@query("""WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS r, c_custkey % 7 AS c, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2)
SELECT a.r AS row, a.c AS col, round(avg(b.v), 4) AS focal FROM c a JOIN c b ON b.r BETWEEN a.r AND a.r + 2 AND b.c BETWEEN a.c AND a.c + 2 GROUP BY 1, 2 HAVING count(*) = 9""")
def focal_mean(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("row"), (F.col("c_custkey") % 7).alias("col")).agg(F.sum("c_acctbal").alias("value"))
    return rounded(windows.focal_window(cells, 3, 3, F.avg("value")), 4)


@query("""WITH m AS (SELECT avg(p_retailprice) AS m FROM part), h AS (SELECT avg(p_retailprice) AS h FROM part, m WHERE p_retailprice > m), l AS (SELECT avg(p_retailprice) AS l FROM part, m WHERE p_retailprice <= m),
h2 AS (SELECT avg(p_retailprice) AS h2 FROM part, h WHERE p_retailprice > h), l2 AS (SELECT avg(p_retailprice) AS l2 FROM part, l WHERE p_retailprice <= l)
SELECT p_partkey, CAST(CAST(p_retailprice >= m AS INT) + CAST(p_retailprice >= h AS INT) + CAST(p_retailprice >= l AS INT) + CAST(p_retailprice >= h2 AS INT) + CAST(p_retailprice >= l2 AS INT) AS INT) AS class FROM part, m, h, l, h2, l2""")
def nested_means_class(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return windows.classify(p, "p_retailprice", windows.nested_mean_breaks(p, "p_retailprice", most=4)).drop("p_retailprice")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id % 5 > 0 THEN value - 60 END AS v FROM events),
c(user_id, event_id, k, v, t) AS (SELECT user_id, event_id, k, v, coalesce(v, 0.0) FROM n WHERE k = 1
UNION ALL SELECT n.user_id, n.event_id, n.k, n.v, coalesce(n.v, 0.0) + CASE WHEN c.t < 0 THEN 0.0 ELSE c.t END FROM c JOIN n ON n.user_id = c.user_id AND n.k = c.k + 1)
SELECT user_id, event_id, round(v, 4) AS v, round(t, 4) AS cumulative FROM c""")
def cumulative_with_reset(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 5 > 0, F.col("value") - 60))
    return rounded(windows.cumulative_with_reset(e, "v", ["event_id"], ["user_id"]), 4)


# text, dates, coordinates


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 30 WHEN contains(p_type, 'SMALL') THEN 20 WHEN contains(p_type, 'PROMO') THEN 10 ELSE -9 END AS code FROM part""")
def reclass_contains(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.reclass_contains("p_type", [("PROMO", 10), ("SMALL", 20), ("BRASS", 30)]).alias("code"))


@query("""SELECT p_partkey, trim(replace(coalesce(p_name, ''), 'part', '')) || ', ' || trim(replace(coalesce(p_brand, ''), 'part', '')) AS joined, replace(replace(p_brand, '#', ''), 'Brand', 'B') AS stripped,
regexp_replace(p_type, '[^0-9 ]', '', 'g') AS digits, regexp_replace(p_name, '[0-9]', '', 'g') AS no_digits, regexp_replace(p_brand, '[^\\p{L} ]', '', 'g') AS letters FROM part""")
def text_cleaning(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        text.concatenate(["p_name", "p_brand"], "comma", ["part"]).alias("joined"),
        F.replace(text.strip_characters("p_brand", ["#"]), F.lit("Brand"), F.lit("B")).alias("stripped"),
        text.keep_digits("p_type").alias("digits"),
        text.strip_digits("p_name").alias("no_digits"),
        text.keep_letters("p_brand").alias("letters"),
    )


@query("""SELECT p_partkey, coalesce(trim(split(p_type, ' ')[1]), '') AS part0, coalesce(trim(split(p_type, ' ')[2]), '') AS part1, coalesce(trim(split(p_type, ' ')[3]), '') AS part2 FROM part""")
def split_field(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", *[c.alias(f"part{i}") for i, c in enumerate(text.split_parts("p_type", " ", 3))])


@query("""SELECT c_custkey, 'a' || substr('0000', 1, CAST(greatest(4 - length('a' || CAST(c_custkey AS VARCHAR)), 0) AS INT)) || CAST(c_custkey AS VARCHAR) AS padded, c_custkey AS leading, substr(c_name, 1, 3) || '+' || substr(c_name, 4) AS parted FROM customer""")
def natural_pad(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    return c.select("c_custkey", text.natural_pad(F.concat(F.lit("a"), k)).alias("padded"), text.leading_int(F.concat(k, F.lit(" x"))).alias("leading"), text.partition_text("c_name").alias("parted"))


@query("""SELECT doc_id, CASE WHEN len(w) > 1 THEN array_to_string(list_concat(w[1:1], w[3:]), ' ') ELSE '' END AS removed FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def remove_word(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.remove_word("text", 1).alias("removed"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d') AS later FROM orders""")
def date_part(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.date_part("o_orderdate").alias("day"), dates.date_part(dates.add_interval("o_orderdate", hours=12, days=1)).alias("later"))


@query("""SELECT event_id, strftime(ts, '%H h %M m ') || printf('%6.2f', round(CAST(strftime(ts, '%S') AS INT) + CAST(strftime(ts, '%f') AS INT) / 1000000.0, 2)) || ' s' AS clock FROM events""")
def time_part(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", dates.time_part("ts").alias("clock"))


@query("""WITH d AS (SELECT c_custkey, c_acctbal / 100 AS v FROM customer), p AS (SELECT *, round(abs(v) * 3600, 6) AS t FROM d)
SELECT c_custkey, CAST(floor(t / 3600) AS BIGINT) AS deg, CAST(floor((t % 3600) / 60) AS BIGINT) AS mins, round(round(t % 60, 6), 3) AS secs, v < 0 AS west,
round(CASE WHEN v >= 1 THEN 1 ELSE -1 END * (floor(t / 3600) + floor((t % 3600) / 60) / 60 + round(t % 60, 4) / 3600), 6) AS back FROM p""")
def dms(spark, sf_dir):
    v = F.col("c_acctbal") / 100
    d, m, s = dates._parts(v)
    sign = F.when(v < 0, "-").otherwise("")
    shown = F.concat(sign, d.cast("string"), F.lit(" "), m.cast("string"), F.lit(" "), F.round(s, 4).cast("string"))
    c = table(spark, sf_dir, "customer")
    return rounded(c.select("c_custkey", d.cast("long").alias("deg"), m.cast("long").alias("mins"), F.round(s, 3).alias("secs"), dates.to_dms(v).endswith("W").alias("west"), dates.from_text(shown).alias("back")))


# points

_NEAR = f"""WITH {XY}, near AS (SELECT a.id, a.x, a.y, b.id AS id2, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d,
row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS n FROM xy a JOIN xy b ON a.id <> b.id),
k AS (SELECT id, row_number() OVER (ORDER BY x, y, id) - 1 AS "ID0" FROM xy)"""
_AZ = "fmod(450.0 - degrees(atan2(y2 - y, x2 - x)), 360.0)"


@query(_NEAR + """ SELECT "ID0" AS "ID", round(any_value(x), 6) AS "Xo", round(any_value(y), 6) AS "Yo", """ + ", ".join(f'round(max(CASE WHEN n = {i + 1} THEN x2 END), 6) AS "C{i}_X", round(max(CASE WHEN n = {i + 1} THEN y2 END), 6) AS "C{i}_Y", round(max(CASE WHEN n = {i + 1} THEN d END), 6) AS "Dist{i}"' for i in range(3)) + """ FROM near JOIN k USING (id) GROUP BY 1""")
def nearest(spark, sf_dir):
    return rounded(points.nearest_wide(xy(spark, sf_dir), 3))


@query(_NEAR + f""" SELECT id AS "Orig", id2 AS "Dest", round(x, 6) AS "X_orig", round(y, 6) AS "Y_orig", round(x2, 6) AS "X_dest", round(y2, 6) AS "Y_dest", round(d, 6) AS "OD_dist", round({_AZ}, 6) AS "Azim_N" FROM near WHERE n <= 2""")
def near_table(spark, sf_dir):
    return rounded(points.near_table(xy(spark, sf_dir), 2))


@query(f"""WITH {XY}, near AS (SELECT a.id, a.x, a.y, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d,
row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS n FROM (SELECT * FROM xy WHERE grp < 5) a CROSS JOIN (SELECT * FROM xy WHERE grp >= 5) b)
SELECT id AS "ID", round(any_value(x), 6) AS "Orig_X", round(any_value(y), 6) AS "Orig_Y", round(max(CASE WHEN n = 1 THEN x2 END), 6) AS "Dest0_X", round(max(CASE WHEN n = 1 THEN y2 END), 6) AS "Dest0_Y", round(max(CASE WHEN n = 1 THEN d END), 6) AS "Dist0",
round(max(CASE WHEN n = 2 THEN x2 END), 6) AS "Dest1_X", round(max(CASE WHEN n = 2 THEN y2 END), 6) AS "Dest1_Y", round(max(CASE WHEN n = 2 THEN d END), 6) AS "Dist1", round(max(CASE WHEN n = 1 THEN degrees(atan2(y2 - y, x2 - x)) END), 6) AS "Angle0" FROM near WHERE n <= 2 GROUP BY id""")
def nearest_destinations(spark, sf_dir):
    p = xy(spark, sf_dir)
    return rounded(points.nearest_destinations(p.where("grp < 5"), p.where("grp >= 5"), 2))


@query(f"""WITH {XY} SELECT a.id, b.id AS id2, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS d FROM xy a JOIN xy b ON (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 0.0004""")
def distance_pairs(spark, sf_dir):
    p = xy(spark, sf_dir)
    return rounded(points.distance_pairs(p, p, 0.02))


@query(_NEAR + """ SELECT DISTINCT round(CASE WHEN (x, y) <= (x2, y2) THEN x ELSE x2 END, 6) AS "X_from", round(CASE WHEN (x, y) <= (x2, y2) THEN y ELSE y2 END, 6) AS "Y_from", round(CASE WHEN (x, y) <= (x2, y2) THEN x2 ELSE x END, 6) AS "X_to", round(CASE WHEN (x, y) <= (x2, y2) THEN y2 ELSE y END, 6) AS "Y_to" FROM near WHERE n <= 2""")
def connect_nearest(spark, sf_dir):
    return rounded(points.connect_nearest(xy(spark, sf_dir), 2))


@query(_NEAR + """ SELECT "ID0" AS "ID", round(any_value(x), 6) AS "X_0", round(any_value(y), 6) AS "Y_0", """ + ", ".join(f'round(max(CASE WHEN n = {i} THEN x2 END), 6) AS "X_{i}", round(max(CASE WHEN n = {i} THEN y2 END), 6) AS "Y_{i}", round(max(CASE WHEN n = {i} THEN d END), 6) AS "d_{i}"' for i in (1, 2)) + """ FROM near JOIN k USING (id) GROUP BY 1""")
def near_table_wide(spark, sf_dir):
    return rounded(points.near_table_wide(xy(spark, sf_dir), 2))


@query(f"""WITH {XY}, d AS (SELECT a.grp, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d FROM xy a JOIN xy b ON a.grp = b.grp AND a.id < b.id),
s AS (SELECT grp, avg(d) AS m, min(d) AS mi, max(d) AS ma, stddev_pop(d) AS sd FROM d WHERE d <> 0 GROUP BY grp)
SELECT grp AS "ID", count(*) AS "N_pnts", round(avg(x), 6) AS "CentX", round(avg(y), 6) AS "CentY", round(min(x), 6) AS "MinX", round(min(y), 6) AS "MinY", round(max(x), 6) AS "MaxX", round(max(y), 6) AS "MaxY", round(sqrt(var_pop(x) + var_pop(y)), 6) AS "Stand_Dist",
round(any_value(m), 6) AS "Mean_dist", round(any_value(mi), 6) AS "Min_dist", round(any_value(ma), 6) AS "Max_dist", round(any_value(sd), 6) AS "Std_dist" FROM xy LEFT JOIN s USING (grp) GROUP BY grp""")
def distance_statistics(spark, sf_dir):
    return rounded(points.distance_statistics(xy(spark, sf_dir), "grp"))


@query(f"""WITH {XY}, g AS (SELECT r * 8 + c AS poly_id, -3 + c * 0.75 AS l, -3 + r * 0.75 AS b FROM range(8) t(r), range(8) u(c))
SELECT id, min(poly_id) AS poly_id FROM xy, g WHERE x > l AND x < l + 0.75 AND y > b AND y < b + 0.75 GROUP BY id""")
def point_in_polygon(spark, sf_dir):
    grid = shapes.sampling_grid(spark, "rectangle", -3, -3, 0.75, 0.75, 8, 8).select(F.col("cell").alias("poly_id"), "ring")
    return points.point_in_polygon(xy(spark, sf_dir), grid)


@query(f"""WITH {XY}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM xy), r AS (SELECT x, y, id, degrees(atan2(y - cy, x - cx)) AS a, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM xy, c)
SELECT row_number() OVER (ORDER BY a, d, id) - 1 AS "IDcent", round(x, 6) AS "Xp", round(y, 6) AS "Yp", round(a, 6) AS "Angle_", round(d, 6) AS "Dist_", id AS "Orig_ID" FROM r""")
def radial_sort(spark, sf_dir):
    return rounded(points.radial_sort(xy(spark, sf_dir)))


@query(f"""WITH {XY}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM (SELECT DISTINCT x, y FROM xy)) SELECT id, grp, round(cx + (x - cx) * cos(radians(30)) + (y - cy) * sin(radians(30)), 6) AS x, round(cy - (x - cx) * sin(radians(30)) + (y - cy) * cos(radians(30)), 6) AS y FROM xy, c""")
def rotate_points(spark, sf_dir):
    return rounded(points.rotate_points(xy(spark, sf_dir), 30)).select("id", "grp", "x", "y")


@query(f"""WITH {XY} SELECT id, round(x + 100.0, 6) AS x, round(y - 50.0, 6) AS y, row_number() OVER (ORDER BY x DESC, y DESC, id DESC) AS place FROM xy""")
def move_sort_points(spark, sf_dir):
    p = points.sort_points(xy(spark, sf_dir).select("id", "x", "y"), "X", ascending=False)
    x, y = planar.translate(F.col("x"), F.col("y"), 100, -50)
    return rounded(p.select("id", x.alias("x"), y.alias("y"), "place"))


@query(f"""WITH {XY}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM xy WINDOW w AS (ORDER BY id)),
q AS (SELECT id, coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0.0) AS dist, coalesce(degrees(atan2(y - py, x - px)), 0.0) AS angle, CASE WHEN px IS NULL THEN 0.0 ELSE fmod(450.0 - degrees(atan2(y - py, x - px)), 360.0) END AS azimuth FROM p)
SELECT id, round(dist, 6) AS dist, round(angle, 6) AS angle, round(azimuth, 6) AS azimuth, round(sum(dist) OVER (ORDER BY id), 6) AS cumu_dist FROM q""")
def distance_previous(spark, sf_dir):
    return rounded(windows.distance_to_previous(xy(spark, sf_dir).select("id", "x", "y"), ["id"]).select("id", "dist", "angle", "azimuth", "cumu_dist"))


@query(f"""WITH {XY} SELECT id, round(sqrt(pow(x - 1, 2) + pow(y - 2, 2)), 6) AS dist, round(fmod(degrees(atan2(y - 2, x - 1)) + 360.0, 360.0), 6) AS azimuth FROM xy""")
def distance_to_point(spark, sf_dir):
    x, y, cx, cy = F.col("x"), F.col("y"), F.lit(1.0), F.lit(2.0)
    return rounded(xy(spark, sf_dir).select("id", planar.distance(cx, cy, x, y).alias("dist"), F.pmod(planar.direction(cx, cy, x, y), F.lit(360.0)).alias("azimuth")))


# shapes


@query("""SELECT r * 11 + c AS "Pnt_num", CAST(c * 2 AS DOUBLE) AS "X", CAST((5 - r) * 2 AS DOUBLE) AS "Y", CAST(c * 2 AS DOUBLE) AS "Xs", CAST((5 - r) * 2 AS DOUBLE) AS "Ys", printf('r%03d c%03d', r, c) AS "RowCol" FROM range(6) t(r), range(11) u(c)""")
def mesh_points(spark, sf_dir):
    return rounded(shapes.mesh_points(spark, 0.0, 0.0, 20.0, 10.0, 2.0, 2.0))


@query("""SELECT CAST(k AS INT) AS pnt_id, round(3 + 10 * cos(radians(180 - 15 * k)), 6) + 0.0 AS x, round(4 + 10 * sin(radians(180 - 15 * k)), 6) + 0.0 AS y FROM range(25) t(k)""")
def circle_points(spark, sf_dir):
    return rounded(shapes.vertices(spark.range(1).select(shapes.circle_ring(10, 15, 3.0, 4.0).alias("ring"))))


@query("""SELECT r AS row, c AS col, CASE WHEN c < 26 THEN chr(CAST(65 + c AS INT)) ELSE chr(CAST(65 + c // 26 - 1 AS INT)) || chr(CAST(65 + c % 26 AS INT)) END || lpad(CAST(r + 1 AS VARCHAR), 2, '0') AS code FROM range(12) t(r), range(40) u(c)""")
def code_grid(spark, sf_dir):
    return shapes.code_grid(spark, 40, 12)


_RECT = "(VALUES (0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 0.0), (4, 0.0, 0.0)) v(pnt_id, px, py)"


@query(f"""SELECT r * 5 + c AS cell, chr(CAST(65 + c AS INT)) || lpad(CAST(r + 1 AS VARCHAR), 2, '0') AS code, CAST(pnt_id AS INT) AS pnt_id,
round(10 + (c + px) * 2 * cos(radians(30)) - (r + py) * 3 * sin(radians(30)), 6) + 0.0 AS x, round(20 + (c + px) * 2 * sin(radians(30)) + (r + py) * 3 * cos(radians(30)), 6) + 0.0 AS y FROM range(4) t(r), range(5) u(c), {_RECT}""")
def grid_rectangle(spark, sf_dir):
    return rounded(shapes.vertices(shapes.sampling_grid(spark, "rectangle", 10, 20, 2, 3, 5, 4, angle=30)))


@query("""SELECT (r * 5 + c) * 2 + k AS cell, chr(CAST(65 + c AS INT)) || lpad(CAST(r + 1 AS VARCHAR), 2, '0') AS code, CAST(pnt_id AS INT) AS pnt_id, CAST((c + px) * 2 AS DOUBLE) AS x, CAST((r + py) * 3 AS DOUBLE) AS y FROM range(4) t(r), range(5) u(c),
(VALUES (0, 0, 0.0, 0.0), (0, 1, 0.5, 1.0), (0, 2, 1.0, 0.0), (0, 3, 0.0, 0.0), (1, 0, 0.5, 1.0), (1, 1, 1.5, 1.0), (1, 2, 1.0, 0.0), (1, 3, 0.5, 1.0)) v(k, pnt_id, px, py)""")
def grid_triangle(spark, sf_dir):
    return rounded(shapes.vertices(shapes.sampling_grid(spark, "triangle", 0, 0, 2, 3, 5, 4)))


@query("""SELECT r * 5 + c AS cell, chr(CAST(65 + c AS INT)) || lpad(CAST(r + 1 AS VARCHAR), 2, '0') AS code, CAST(k AS INT) AS pnt_id, round(c * 1.5 * 2 + 2 * cos(radians(180 - 60 * k)), 6) + 0.0 AS x, round(r * sqrt(3) * 2 + (c % 2) * sqrt(3) / 2 * 2 + 2 * sin(radians(180 - 60 * k)), 6) + 0.0 AS y FROM range(4) t(r), range(5) u(c), range(7) v(k)""")
def grid_hex_flat(spark, sf_dir):
    return rounded(shapes.vertices(shapes.sampling_grid(spark, "hex_flat", 0, 0, 2, 2, 5, 4)))


@query("""SELECT r * 5 + c AS cell, chr(CAST(65 + c AS INT)) || lpad(CAST(r + 1 AS VARCHAR), 2, '0') AS code, CAST(k AS INT) AS pnt_id, round(c * sqrt(3) * 2 + (r % 2) * sqrt(3) / 2 * 2 + 2 * cos(radians(150 - 60 * k)), 6) + 0.0 AS x, round(r * 1.5 * 2 + 2 * sin(radians(150 - 60 * k)), 6) + 0.0 AS y FROM range(4) t(r), range(5) u(c), range(7) v(k)""")
def grid_hex_pointy(spark, sf_dir):
    return rounded(shapes.vertices(shapes.sampling_grid(spark, "hex_pointy", 0, 0, 2, 2, 5, 4)))


@query("""SELECT k AS line_id, CAST(10 * k AS DOUBLE) AS "X_from", CAST(0 AS DOUBLE) AS "Y_from", round(10 * k + 100 * sin(radians(45)), 6) AS "X_to", round(100 * cos(radians(45)), 6) AS "Y_to" FROM range(5) t(k)""")
def transects(spark, sf_dir):
    return rounded(shapes.transects(spark, 5, 0, 0, 100, x_offset=10, bearing=45))


@query("""SELECT k AS pnt_id, round(k / 12.0 * pi() * cos(k / 12.0 * pi()), 6) + 0.0 AS x, round(k / 12.0 * pi() * sin(k / 12.0 * pi()), 6) + 0.0 AS y FROM range(100) t(k)""")
def spiral(spark, sf_dir):
    return rounded(shapes.spiral(spark, 100, 12))


@query("""WITH RECURSIVE s(k, x, y) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, x + ceil((k + 1) / 2.0) * CASE (k + 1) % 4 WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END, y + ceil((k + 1) / 2.0) * CASE (k + 1) % 4 WHEN 2 THEN -1 WHEN 0 THEN 1 ELSE 0 END FROM s WHERE k < 60)
SELECT CAST(k AS BIGINT) AS pnt_id, x, y FROM s""")
def square_spiral(spark, sf_dir):
    return rounded(shapes.square_spiral(spark, 60))


@query("""SELECT s AS sector, CAST(k AS INT) AS pnt_id, CASE WHEN k IN (0, 3) THEN 0.0 ELSE round(5 * cos(radians(180 - 30 * (s + k - 1))), 6) + 0.0 END AS x, CASE WHEN k IN (0, 3) THEN 0.0 ELSE round(5 * sin(radians(180 - 30 * (s + k - 1))), 6) + 0.0 END AS y FROM range(12) t(s), range(4) u(k)""")
def sectors(spark, sf_dir):
    return rounded(shapes.vertices(shapes.sectors(spark, 5, 30)))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each part, sized by its numbers."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"), (F.col("p_retailprice") / 100).alias("h"))
    at = lambda a, b: F.struct((F.col("w") * a).alias("x"), (F.col("h") * b).alias("y"))
    return p.withColumn("ring", F.array(at(0, 0), at(0, 1), at(1, 1), at(1, 0), at(0, 0)))


@query("""SELECT id, round(w * h, 6) AS area, round(2 * (w + h), 6) AS length, CAST(360 AS DOUBLE) AS angles, round((w + h) / 2, 6) AS side, CAST(17 AS INT) AS dense, round(2 * (w + h), 6) AS dense_length, CAST(0 AS DOUBLE) AS half_x, round(h / 2, 6) AS half_y FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS h FROM part)""")
def ring_measures(spark, sf_dir):
    r = F.col("ring")
    dense = planar.densify(r, 4)
    half = planar.point_along(F.slice(r, 1, 2), 0.5, use_fraction=True)
    return rounded(squares(spark, sf_dir).select("id", planar.ring_area(r).alias("area"), planar.ring_length(r).alias("length"), planar.angles_summary(r).alias("angles"), planar.side_lengths(r).alias("side"), F.size(dense).alias("dense"), planar.ring_length(dense).alias("dense_length"), half["x"].alias("half_x"), half["y"].alias("half_y")))


@query("""SELECT id, CAST(k AS INT) AS pnt_id, round(CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN w ELSE w END, 6) AS x, round(CASE k WHEN 0 THEN 0 WHEN 1 THEN h WHEN 2 THEN h ELSE 0 END, 6) AS y FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS h FROM part), range(4) t(k)""")
def polygon_points(spark, sf_dir):
    return rounded(shapes.vertices(squares(spark, sf_dir).select("id", "ring"), closing=False))


@query("""SELECT id, round(sum(w * h), 6) AS area, count(*) AS parts FROM (SELECT p_partkey AS id, p_size AS w, p_retailprice / 100 / 4 AS h FROM part, range(4)) GROUP BY id""")
def split_polygons(spark, sf_dir):
    parts = grouped.split_rings(squares(spark, sf_dir), "id", "extent", 4, "Y")
    return rounded(parts.groupBy("id").agg(F.sum(planar.ring_area(F.col("ring"))).alias("area"), F.count(F.lit(1)).alias("parts")))


#: Directed sides of each group's convex hull: all other points lie to their left.
HULL = f"""{XY}, d AS (SELECT DISTINCT grp, x, y FROM xy), h AS (SELECT a.grp, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM d a JOIN d b ON a.grp = b.grp AND (a.x, a.y) <> (b.x, b.y)
WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.grp = a.grp AND (c.x, c.y) <> (a.x, a.y) AND (c.x, c.y) <> (b.x, b.y) AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <= 0)),
hull AS (SELECT grp, count(*) AS corners, sum(x0 * y1 - x1 * y0) / 2 AS area FROM h GROUP BY grp), n AS (SELECT grp, count(*) AS n FROM d GROUP BY grp)"""


def _sized(parts: DataFrame) -> DataFrame:
    """Area of each group's numbered part."""
    whole = shapes.rings(parts.withColumn("key", F.struct("grp", "part")), "key", close=True)
    return whole.select(F.col("key.grp").alias("grp"), F.col("key.part").alias("part"), planar.ring_area(F.col("ring")).alias("area"))


@query(f"WITH {HULL} SELECT grp, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM h")
def convex_hull(spark, sf_dir):
    """Each hull's sides."""
    corners = grouped.convex_hulls(xy(spark, sf_dir), "grp")
    following = Window.partitionBy("grp").orderBy("pnt_id")
    sides = corners.select("grp", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(following).alias("x1"), F.lead("y").over(following).alias("y1"))
    return rounded(sides.where("x1 is not null"))


@query(f"WITH {HULL} SELECT grp, n - 0 AS held, true AS smaller FROM n JOIN hull USING (grp)")
def concave_hull(spark, sf_dir):
    """How many of its points each hull holds or has as corners, and whether it is no larger than the convex one."""
    p = xy(spark, sf_dir).select("grp", "x", "y").distinct()
    ring = shapes.rings(grouped.concave_hulls(p, "grp"), "grp").select(F.col("grp").alias("g"), "ring")
    convex = shapes.rings(grouped.convex_hulls(p, "grp"), "grp").select(F.col("grp").alias("c"), planar.ring_area(F.col("ring")).alias("convex"))
    at_corner = F.exists("ring", lambda q: (q["x"] == F.col("x")) & (q["y"] == F.col("y")))
    held = p.join(ring, F.col("grp") == F.col("g")).where(at_corner | planar.contains_point(F.col("ring"), F.col("x"), F.col("y"))).groupBy("grp").agg(F.count(F.lit(1)).alias("held"))
    sizes = ring.join(convex, F.col("g") == F.col("c")).select("g", (planar.ring_area(F.col("ring")) <= F.col("convex") + 1e-9).alias("smaller"))
    return held.join(sizes, F.col("grp") == F.col("g")).select("grp", "held", "smaller")


@query(f"""WITH RECURSIVE {XY}, n AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY x, y) - 1 AS INT) AS i, x, y FROM xy),
e AS (SELECT a.grp, a.i AS a, b.i AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM n a JOIN n b ON a.grp = b.grp AND a.i <> b.i),
t(grp, seen, a, b, d) AS (SELECT DISTINCT grp, [0], -1, 0, 0.0::DOUBLE FROM n
UNION ALL SELECT t.grp, list_append(t.seen, arg_min(e.b, e.d)), arg_min(e.a, e.d), arg_min(e.b, e.d), min(e.d) FROM t JOIN e ON e.grp = t.grp AND list_contains(t.seen, e.a) AND NOT list_contains(t.seen, e.b) GROUP BY t.grp, t.seen)
SELECT grp, a AS "Orig", b AS "Dest", round(d, 6) AS "Dist" FROM t WHERE a >= 0""")
def spanning_tree(spark, sf_dir):
    return rounded(grouped.spanning_trees(xy(spark, sf_dir), "grp"))


@query(f"WITH {HULL} SELECT grp, 2 * n - 2 - corners AS triangles, round(area, 6) AS area FROM n JOIN hull USING (grp)")
def delaunay(spark, sf_dir):
    """Each group's number of triangles, and the area that they fill."""
    sizes = _sized(grouped.triangulate(xy(spark, sf_dir), "grp"))
    return rounded(sizes.groupBy("grp").agg(F.count(F.lit(1)).alias("triangles"), F.sum("area").alias("area")))


@query(f"WITH {XY}, d AS (SELECT DISTINCT grp, x, y FROM xy) SELECT grp, count(*) AS cells, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS area FROM d GROUP BY grp")
def voronoi(spark, sf_dir):
    """Each group's number of cells, and the area that they fill."""
    sizes = _sized(grouped.voronoi_cells(xy(spark, sf_dir), "grp", clip_to_extent=True))
    return rounded(sizes.groupBy("grp").agg(F.count(F.lit(1)).alias("cells"), F.sum("area").alias("area")))


@query(f"WITH {XY} SELECT grp, true AS spaced, true AS inside, true AS some FROM xy GROUP BY grp")
def spaced_points(spark, sf_dir):
    boxes = xy(spark, sf_dir).groupBy("grp").agg(*tables.extent())
    p = grouped.spaced_points(boxes, "grp", 0.3, 40)
    pairs = p.select("grp", "pnt_id", "x", "y").join(p.select("grp", F.col("pnt_id").alias("q"), F.col("x").alias("u"), F.col("y").alias("v")), "grp").where("pnt_id < q")
    near = pairs.groupBy("grp").agg(F.min(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))).alias("d"))
    within = p.join(boxes, "grp").groupBy("grp").agg(F.bool_and(F.col("x").between(F.col("L"), F.col("R")) & F.col("y").between(F.col("B"), F.col("T"))).alias("inside"), F.count(F.lit(1)).alias("n"))
    return within.join(near, "grp", "left").select("grp", (F.coalesce(F.col("d"), F.lit(1.0)) > 0.3).alias("spaced"), "inside", F.col("n").between(1, 40).alias("some"))


@query("""SELECT id, round(least(w, 20) * least(h, 5), 6) AS area FROM (SELECT p_partkey AS id, p_size AS w, p_retailprice / 100 AS h FROM part)""")
def clip_polygons(spark, sf_dir):
    clipped = shapes.rings(grouped.clip_polygons(squares(spark, sf_dir), "id", 0, 0, 20, 5), "id")
    return rounded(clipped.select("id", planar.ring_area(F.col("ring")).alias("area")))


@query("""SELECT id, round(w * h, 6) AS area, 'a' || CAST(id AS VARCHAR) AS shown FROM (SELECT p_partkey AS id, p_size AS w, p_retailprice / 100 AS h FROM part)""")
def calculator(spark, sf_dir):
    shown = squares(spark, sf_dir).withColumn("label", F.concat(F.lit("a"), F.col("id")))
    out = registry.calculate(registry.calculate(shown, "area", ["ring"], "area"), "keep digits", ["label"], "digits")
    return rounded(out.select("id", "area", F.concat(F.lit("a"), F.col("digits")).alias("shown")))


@query("""SELECT p_partkey AS id, round(p_size / 2, 6) AS x, round(p_retailprice / 200, 6) AS y FROM part""")
def centroids(spark, sf_dir):
    return rounded(features.feature_points(squares(spark, sf_dir), ["id"]))


@query("SELECT p_partkey AS id, CAST(2 AS BIGINT) AS triangles, round(p_size * p_retailprice / 100, 6) AS area FROM part")
def triangulate_polygons(spark, sf_dir):
    triangles = grouped.triangle_rings(squares(spark, sf_dir), "id")
    whole = triangles.select("id", planar.ring_area(shapes.closed(F.col("ring"))).alias("area"))
    return rounded(whole.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"), F.sum("area").alias("area")))


@query("""SELECT id, CAST(90 AS DOUBLE) AS a0, CAST(90 AS DOUBLE) AS a1, 3 AS n FROM (SELECT p_partkey AS id FROM part)""")
def signed_angles(spark, sf_dir):
    a = planar.signed_angles(F.col("ring"))
    return rounded(squares(spark, sf_dir).select("id", a[0].alias("a0"), a[2].alias("a1"), F.size(a).alias("n")))


#: Area on the authalic sphere of WGS84 between the equator and a latitude, for each degree of longitude: a closed form.
_AUTHALIC = """WITH c AS (SELECT 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2), s AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, sin(radians(p_retailprice / 100)) AS s FROM part)
SELECT id, round(radians(w) * pow(6378.137, 2) / 2 * (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - sqrt(e2) * s) / (1 + sqrt(e2) * s)) / (2 * sqrt(e2))), 3) AS area_km2 FROM s, c"""


@query(_AUTHALIC)
def geodesic_measures(spark, sf_dir):
    return rounded(grouped.geodesic_measures(squares(spark, sf_dir), "id").select("id", "area_km2"), 3)


@query()
def geodesic_lengths(spark, sf_dir):
    return rounded(grouped.geodesic_measures(squares(spark, sf_dir), "id").select("id", "length_km"))


@query()
def geodesic_inverse(spark, sf_dir):
    p = xy(spark, sf_dir).select("id", (F.col("x") * 30).alias("lon0"), (F.col("y") * 20).alias("lat0"), F.lit(-75.0).alias("lon1"), F.lit(45.0).alias("lat1"))
    g = p.withColumn("g", grouped.geodesic("lon0", "lat0", "lon1", "lat1"))
    return rounded(g.select("id", "g.Distance_m", "g.Orig_Bearing", "g.Dest_Bearing"), 4)
