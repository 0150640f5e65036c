"""Queries of scans, sinks, selections, joins, orderings and sets, with the same in SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import planar, text
from tessera.operators import shapes, tables, windows
from tessera.plans.catalog import squares
from tessera.plans.ordered import shared_dir
from tessera.plans.registered import XY, query, rounded, table, xy
from tessera.sources import features, files


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}_{uuid.uuid4().hex}"


# scans and sinks


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def table_scan(spark, sf_dir):
    return features.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'")


@query("SELECT * FROM region")
def table_scan_all_fields(spark, sf_dir):
    return features.scan(spark, f"{sf_dir}/region.parquet")


@query(f"WITH {XY} SELECT min(id) AS id, x, y FROM xy GROUP BY x, y")
def distinct_points(spark, sf_dir):
    return features.distinct_points(xy(spark, sf_dir))


@query("WITH s AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS h FROM part) SELECT id, CAST(k AS INT) AS pnt_id, CASE WHEN k IN (2, 3) THEN w ELSE 0.0 END AS x, CASE WHEN k IN (1, 2) THEN round(h, 6) ELSE 0.0 END AS y FROM s, range(5) t(k)")
def geometry_cursor(spark, sf_dir):
    return rounded(features.feature_points(squares(spark, sf_dir), ["id"], all_points=True))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'None') AS name, coalesce(CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS VARCHAR), '-2147483648') AS number FROM customer")
def null_markers(spark, sf_dir):
    k = F.col("c_custkey")
    return files.as_text(table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.when(k % 3 == 0, k).alias("number")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_sink(spark, sf_dir):
    where = _folder(spark, "nations")
    files.write_table(table(spark, sf_dir, "nation"), where)
    return spark.read.parquet(where)


@query("SELECT 'n_nationkey, n_name' AS line UNION ALL SELECT CAST(n_nationkey AS VARCHAR) || ', ' || n_name FROM nation")
def csv_sink(spark, sf_dir):
    where = _folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), where, single_file=True)
    return spark.read.text(where).withColumnRenamed("value", "line")


@query("""WITH w AS (SELECT max(length(n_name)) AS n FROM nation) SELECT lpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || ' ' || lpad(n_name, CAST(greatest(n, 6) AS INT), ' ') || ' ' || lpad(printf('%.2f', n_nationkey / 4), 4, ' ') AS line FROM nation, w""")
def fixed_width(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return files.fixed_width_lines(n.select("n_nationkey", "n_name", (F.col("n_nationkey") / 4).alias("q")))


@query("""SELECT lpad(CAST(k AS VARCHAR), 1, ' ') || ' ' || lpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' ' || lpad(r_name, CAST(w AS INT), ' ') AS line FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS k, greatest(max(length(r_name)) OVER (), 6) AS w FROM region)
UNION ALL SELECT 'n r_regionkey ' || lpad('r_name', CAST((SELECT greatest(max(length(r_name)), 6) FROM region) AS INT), ' ')""")
def record_print(spark, sf_dir):
    lines = files.print_table(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"]).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("""WITH c AS (SELECT o_orderpriority AS r, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS t FROM orders GROUP BY 1)
SELECT lpad(r, CAST((SELECT greatest(max(length(r)), 15) FROM c) AS INT), ' ') || ' ' || lpad(CAST(f AS VARCHAR), CAST((SELECT greatest(max(length(CAST(f AS VARCHAR))), 1) FROM c) AS INT), ' ') || ' ' || lpad(CAST(o AS VARCHAR), CAST((SELECT greatest(max(length(CAST(o AS VARCHAR))), 1) FROM c) AS INT), ' ') || ' ' || lpad(CAST(t AS VARCHAR), CAST((SELECT greatest(max(length(CAST(t AS VARCHAR))), 5) FROM c) AS INT), ' ') AS line FROM c""")
def crosstab_report(spark, sf_dir):
    return files.fixed_width_lines(tables.crosstab_dense(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O"]))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def npy_scan(spark, sf_dir):
    where = _folder(spark, "npy") + "/nation.npy"
    files.write_bytes(spark, where, files.npy_bytes(table(spark, sf_dir, "nation")))
    return files.read_npy(spark, where).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT n_nationkey AS f0, n_regionkey AS f1 FROM nation")
def array_to_structured(spark, sf_dir):
    """Columns of an array named by their place, with a type."""
    n = table(spark, sf_dir, "nation").select(F.array("n_nationkey", "n_regionkey").alias("a"))
    return n.select(*[F.get("a", i).cast("int").alias(f"f{i}") for i in range(2)])


@query("""SELECT CAST(n_nationkey AS BIGINT) AS "Number", n_name AS "Name", CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS DOUBLE) / 2 END AS "Half_1" FROM nation""")
def excel_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    where = _folder(spark, "xlsx") + "/nation.xlsx"
    cells = [["Number", "Name", "Half 1"], *[[r.n_nationkey, r.n_name, r.n_regionkey / 2 if r.n_regionkey else None] for r in rows]]
    files.write_bytes(spark, where, files.xlsx_bytes(cells))
    return files.read_xlsx(spark, where)


@query("SELECT CAST(7 AS BIGINT) AS rows, CAST(5 AS BIGINT) AS cols, CAST(34 AS BIGINT) AS n, 0.0::DOUBLE AS min, 33.0::DOUBLE AS max, 16.5::DOUBLE AS mean, round(sqrt((34 * 34 - 1) / 12.0), 6) AS std, 101.0::DOUBLE AS left, 201.0::DOUBLE AS bottom, 109.0::DOUBLE AS right, 213.0::DOUBLE AS top")
def raster_info(spark, sf_dir):
    cells = files.raster_cells(spark, np.arange(35).reshape(7, 5), 100.0, 200.0, 2.0, nodata=34)
    return rounded(files.raster_info(cells).select(F.col("rows").cast("long").alias("rows"), F.col("cols").cast("long").alias("cols"), "n", "min", "max", "mean", "std", "left", "bottom", "right", "top"))


@query(f"WITH {XY} SELECT id, CAST(k AS INT) AS pnt_id, CASE k WHEN 0 THEN 0.0 ELSE x END AS x, CASE k WHEN 0 THEN 0.0 ELSE y END AS y FROM xy, range(2) t(k)")
def xy_to_line(spark, sf_dir):
    p = xy(spark, sf_dir).withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0)})
    return shapes.vertices(shapes.lines(p, "x0", "y0", "x", "y").select("id", "ring"))


# selections


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def project_rename_where(spark, sf_dir):
    return features.scan(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name"], "c_acctbal > 0 and c_mktsegment <> 'BUILDING'").toDF("id", "name")


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment AS both FROM customer")
def positional_join(spark, sf_dir):
    """Values of the same row side by side."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.concatenate(["c_name", "c_mktsegment"], "space").alias("both"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
def limit_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(7)


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT n_regionkey, n_nationkey, CAST(k AS INT) AS copy, row_number() OVER (PARTITION BY n_regionkey, k ORDER BY n_nationkey DESC) AS place FROM nation, range(3) t(k)")
def split_repeat_reverse(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("n_regionkey", "copy").orderBy(F.desc("n_nationkey"))).cast("long"))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def hash_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def merge_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").hint("merge")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH c AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'click') SELECT e.event_id, (SELECT max(c.event_id) FROM c WHERE c.user_id = e.user_id AND c.event_id < e.event_id) AS last_click FROM events e WHERE e.event_type <> 'click'""")
def as_of_join(spark, sf_dir):
    """Of each other event, the user's last click before it: one pass over the user's events in order."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return e.withColumn("last_click", F.last(click, ignorenulls=True).over(before)).where("event_type <> 'click'").select("event_id", "last_click")


@query("SELECT p_partkey, CAST(k AS INT) AS band FROM part JOIN range(9) t(k) ON p_retailprice >= 850 + k * 25 AND p_retailprice < 850 + (k + 2) * 25")
def interval_join(spark, sf_dir):
    """Overlapping price bands, dealt to cells of their step so that rows meet by equality."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.floor((F.col("p_retailprice") - 850) / 25).alias("cell"))
    bands = spark.range(9).select(F.col("id").cast("int").alias("band"), F.explode(F.sequence(F.col("id"), F.col("id") + 1)).alias("cell"))
    low = 850 + F.col("band") * 25
    return p.join(F.broadcast(bands), "cell").where((F.col("p_retailprice") >= low) & (F.col("p_retailprice") < low + 50)).select("p_partkey", "band")


# aggregates and windows


@query(f"WITH {XY} SELECT count(DISTINCT grp) AS groups, count(DISTINCT (x, y)) AS places FROM xy")
def distinct_rows(spark, sf_dir):
    return xy(spark, sf_dir).agg(F.count_distinct("grp").alias("groups"), F.count_distinct(planar.point("x", "y")).alias("places"))


@query("""SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def rollup_totals(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("level")), 2)


@query("SELECT true AS near FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)")
def approximate_distinct(spark, sf_dir):
    # apart: beside a distinct count, one sketch would be held for every distinct value
    keys = table(spark, sf_dir, "lineitem").select("l_partkey")
    both = keys.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a")).crossJoin(keys.agg(F.count_distinct("l_partkey").alias("n")))
    return both.select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


_MOMENTS = " UNION ALL ".join(
    f"""SELECT '{f}' AS "Field", round(sum({f}), 4) AS "Sum", round(min({f}), 4) AS "Min", round(max({f}), 4) AS "Max", round(median({f}), 4) AS "Med", round(avg({f}), 4) AS "Avg" FROM customer""" for f in ("c_acctbal", "c_custkey")
)


@query(_MOMENTS)
def field_statistics_without_n(spark, sf_dir):
    return rounded(tables.field_statistics(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"], with_n=False).select("Field", "Sum", "Min", "Max", "Med", "Avg"), 4)


@query("""SELECT event_id, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS percent, first_value(value) OVER w AS first, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, lead(value) OVER w AS next
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def rank_family(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(w).cast("long").alias("quarter"), F.percent_rank().over(w).alias("percent"), F.first("value").over(w).alias("first"), F.last("value").over(whole).alias("last"), F.lead("value").over(w).alias("next")))


@query("""WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS r, c_custkey % 7 AS c, c_custkey % 2 AS z, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2, 3)
SELECT a.z AS layer, a.r AS row, a.c AS col, round(avg(b.v), 4) AS focal FROM c a JOIN c b ON b.r BETWEEN a.r AND a.r + 1 AND b.c BETWEEN a.c AND a.c + 1 AND b.z BETWEEN a.z AND a.z + 1 GROUP BY 1, 2, 3 HAVING count(*) = 8""")
def focal_volume(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 2).alias("layer"), F.col("c_nationkey").cast("long").alias("row"), (F.col("c_custkey") % 7).alias("col")).agg(F.sum("c_acctbal").alias("value"))
    return rounded(windows.focal_cells(cells, {"layer": 2, "row": 2, "col": 2}, F.avg("value")), 4)
