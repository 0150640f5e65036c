"""Golden results of the operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, planar, text
from tessera.operators import points, shapes, tables, windows
from tessera.plans import catalog  # noqa: F401
from tessera.plans.ordered import Ordered
from tessera.plans.registered import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def value(spark, column, v, kind="string"):
    return frame(spark, [(v,)], f"v {kind}").select(column).first()[0]


def test_ordered_over_many_blocks(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") % 7).cast("long"))
    o = Ordered(df, ["id"], blocks=6).with_number("n").with_sum("s", F.col("v")).with_lag("p", F.col("v"), -1)
    total = 0
    before = -1
    for r in o.df.orderBy("id").collect():
        total += r.v
        assert (r.n, r.s, r.p) == (r.id + 1, total, before)
        before = r.v


def test_lag_keeps_null_values_apart_from_the_default(spark):
    df = frame(spark, [(1, None), (2, 5), (3, None), (4, 6)], "id int, v int")
    got = [r.p for r in Ordered(df, ["id"], blocks=3).with_lag("p", F.col("v"), 0).df.orderBy("id").collect()]
    assert got == [0, None, 5, None]


@pytest.mark.parametrize(
    ("values", "step", "expected"),
    [
        ([1, 2, 3, 4, 4, 5], 1, [(0, 1, 4, 0, 4), (1, 4, 2, 4, 6)]),
        ([1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5, 5, 4, 4, 3, 3, 3, 2, 1], 0, [(0, 1, 2, 0, 2), (1, 2, 2, 2, 4), (2, 3, 3, 4, 7), (3, 4, 2, 7, 9), (4, 5, 4, 9, 13), (5, 4, 2, 13, 15), (6, 3, 3, 15, 18), (7, 2, 1, 18, 19), (8, 1, 1, 19, 20)]),
    ],
)
def test_run_lengths(spark, values, step, expected):
    df = frame(spark, list(enumerate(values)), "id int, v int")
    assert [tuple(r) for r in windows.run_lengths(df, "v", ["id"], step).orderBy("ID").collect()] == expected


def test_windows_with_nulls(spark):
    df = frame(spark, [(1, None), (2, 2.0), (3, None), (4, 6.0)], "id int, v double")
    assert [r.c for r in windows.cumulative_sum(df, "v", ["id"], "c").orderBy("id").collect()] == [0.0, 2.0, 2.0, 8.0]
    assert [r.d for r in windows.difference_from(df, "v", "mean", "d").orderBy("id").collect()] == [None, -2.0, None, 2.0]
    assert [r.d for r in windows.sequential_difference(df, "v", ["id"], "d").orderBy("id").collect()] == [0.0, None, None, None]
    assert [r.p for r in windows.percent(df, "v", "p").orderBy("id").collect()] == [None, 25.0, None, 75.0]
    moved = windows.moving_window(df, "v", ["id"], "mean", 3, "m").orderBy("id").collect()
    assert [r.m for r in moved] == [None, 2.0, 4.0, None]
    with pytest.raises(ValueError):
        windows.moving_window(df, "v", ["id"], "mean", 4)


def test_rank_ties(spark):
    df = frame(spark, [(1, 5), (2, 3), (3, 5), (4, 9)], "id int, v int")
    assert {r.id: r.Rank for r in windows.rank_min(df, "v").collect()} == {1: 1, 2: 0, 3: 1, 4: 3}


def test_sequential_duplicate_of_a_first_empty_text(spark):
    df = frame(spark, [(1, ""), (2, None), (3, None), (4, "a")], "id int, v string")
    assert [r["dup"] for r in windows.sequential_duplicate(df, "v", ["id"]).orderBy("id").collect()] == [1, 0, 1, 0]
    numbers = frame(spark, [(1, None), (2, None), (3, 4)], "id int, v int")
    assert [r["dup"] for r in windows.sequential_duplicate(numbers, "v", ["id"]).orderBy("id").collect()] == [0, 1, 0]


def test_cumulative_restarts_below_zero(spark):
    df = frame(spark, [("a", i, v) for i, v in enumerate([5.0, -8.0, 4.0, 1.0])], "g string, id int, v double")
    got = windows.cumulative_with_reset(df, "v", ["id"], ["g"]).orderBy("id").collect()
    assert [r.cumulative for r in got] == [5.0, -3.0, 4.0, 5.0]


def test_statistics_skip_nan(spark):
    df = frame(spark, [(v,) for v in [1.0, 2.0, float("nan"), 3.0, None, 4.0]], "v double")
    r = tables.field_statistics(df, ["v"]).first()
    assert (r.N, r.Sum, r.Avg) == (4, 10.0, 2.5)


def test_frequency_of_all_null_group(spark):
    df = frame(spark, [("a", None), ("a", None), (None, 1.0)], "k string, v double")
    got = {r.k: (r.Counts, r.v_sums, r.v_NaN, r.v_mean) for r in tables.frequency(df, ["k"], "v").collect()}
    assert got == {"a": (2, 0.0, 2, None), None: (1, 1.0, 0, 1.0)}


@pytest.mark.parametrize(("given", "expected"), [("a1", "a001"), ("a20", "a020"), ("a2", "a002"), ("a10", "a010")])
def test_natural_pad(spark, given, expected):
    assert value(spark, text.natural_pad("v"), given) == expected


def test_natural_sort(spark):
    df = frame(spark, [("a1",), ("a20",), ("a2",), ("a10",)], "v string")
    assert [r.v for r in df.orderBy(text.natural_key("v")).collect()] == ["a1", "a2", "a10", "a20"]


@pytest.mark.parametrize(("column", "given", "expected"), [
    (lambda: text.remove_word("v", -1), "a b c", "a b"),
    (lambda: text.remove_word("v", 5), "a b c", ""),
    (lambda: text.partition_text("v"), "abcdef", "abc+def"),
    (lambda: text.partition_text("v"), "aaaa", "+a"),
    (lambda: text.partition_text("v"), "abc", None),
    (lambda: text.leading_int("v"), "12ab", 12),
    (lambda: text.leading_int("v"), "ab", None),
    (lambda: text.numbers_list("v"), "1 a 22 b3 4", "1, 22, 4"),
    (lambda: text.collapse_spaces("v"), "  a   b ", "a b"),
    (lambda: text.strip_characters("v", extra=True), "a    b   c  d", "a b c d"),
    (lambda: text.de_punctuate("v"), "a.b c_d", "a_b_c_d"),
    (lambda: dates.from_text("v"), "45 30.30", 45.505),
    (lambda: dates.from_text("v"), "-75 45.45", -75.7575),
    (lambda: dates.from_text("v"), "45 30 30.30", 45.508416666666665),
    (lambda: dates.date_text("v"), "2017-6-7 10:00", "2017-06-07"),
])
def test_text_functions(spark, column, given, expected):
    got = value(spark, column(), given)
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_reclass_later_pairs_win(spark):
    assert value(spark, text.reclass_contains("v", [("Street", 10), ("Court", 30)]), "Court Street") == 30
    assert value(spark, text.reclass_contains("v", [("Street", 10)]), "Lane") == -9


def test_concatenate_keeps_separators_of_nulls(spark):
    df = frame(spark, [("a", None, " c ")], "x string, y string, z string")
    assert df.select(text.concatenate(["x", "y", "z"], "comma")).first()[0] == "a, , c"
    assert df.select(text.join_non_null(["x", "y"])).first()[0] == "a"


def test_dates(spark):
    df = spark.sql("SELECT timestamp '2017-06-17 20:35:58.777353' AS t, -75.25D AS v")
    got = df.select(dates.date_part("t"), dates.time_part("t"), dates.to_dms("v"), dates.to_dmm("v")).first()
    assert list(got) == ["2017-06-17", "20 h 35 m  58.78 s", "75-15-00.00W", "75 15.00' W"]


def test_time_part_rounds_ties_as_its_sql(spark, tmp_path):
    """Every time of a minute that ends in half a hundredth, and its neighbours."""
    spark.sql("SELECT 3 * id + k AS event_id, timestamp_micros(1704067200000000 + id * 10000 + 4999 + k) AS ts FROM range(6000) LATERAL VIEW explode(array(0, 1, 2)) AS k").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert_same(QUERIES["time_part"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL["time_part"])


def test_transects(spark):
    got = shapes.transects(spark, 5, 0, 0, 100, x_offset=10, bearing=45).orderBy("line_id").collect()
    assert [(r.X_from, round(r.X_to, 2), round(r.Y_to, 2)) for r in got] == [(10.0 * i, round(70.71 + 10 * i, 2), 70.71) for i in range(5)]


def test_code_grid(spark):
    got = [r.code for r in shapes.code_grid(spark, 5, 3).orderBy("row", "col").collect()]
    assert got == [f"{c}{r:02d}" for r in (1, 2, 3) for c in "ABCDE"]


def test_spiral_order(spark):
    df = spark.range(12).select((F.col("id") / 4).cast("int").alias("r"), (F.col("id") % 4).cast("int").alias("c"))
    got = df.select("r", "c", shapes.spiral_order(F.lit(3), F.lit(4), F.col("r"), F.col("c")).alias("k")).orderBy("k").collect()
    assert [(x.r, x.c) for x in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (2, 2), (2, 1), (2, 0), (1, 0), (1, 1), (1, 2)]


def test_nearest_with_ties_and_short_tables(spark):
    p = frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 8), (10, 8), (10, 0), (3, 4), (7, 4)])], "id int, x double, y double")
    near = points.nearest(p, p, 2, exclude_same=True).orderBy("id", "n").collect()
    assert [r.d for r in near] == [5, 8, 5, 8, 5, 8, 5, 8, 4, 5, 4, 5]
    assert points.nearest(p, p, 9, exclude_same=True).count() == 30
    assert points.nearest(p, p.limit(0), 2).count() == 0


def test_nearest_far_origins(spark):
    p = frame(spark, [(1, 0.0, 0.0), (2, 1.0, 0.0)], "id int, x double, y double")
    far = frame(spark, [(9, 1000.0, 1000.0)], "id int, x double, y double")
    assert [r.id2 for r in points.nearest(far, p, 1).collect()] == [2]


def test_boundary_is_outside(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]])
    df = frame(spark, [(0.5, 0.5), (0.0, 0.5), (1.0, 1.0), (2.0, 0.5)], "x double, y double")
    assert [r[0] for r in df.select(planar.contains_point(ring, F.col("x"), F.col("y"))).collect()] == [True, False, False, False]


def test_ring_measures(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 0)]])
    r = spark.range(1).select(planar.ring_area(ring), planar.ring_length(ring), planar.angles_summary(ring), planar.ring_length(planar.densify(ring, 5)), planar.point_along(ring, 5.5)["y"]).first()
    assert list(r) == pytest.approx([6.0, 12.0, 180.0, 12.0, 1.5])


def test_distance_statistics_in_blocks(spark):
    rows = [(i, "a" if i < 40 else "b", float(i * 7 % 13), float(i * 5 % 11)) for i in range(60)] + [(99, "one", 1.0, 1.0), (100, None, 0.0, 0.0), (101, None, 3.0, 4.0)]
    df = frame(spark, rows, "id int, g string, x double, y double")
    whole = {r.ID: r for r in points.distance_statistics(df, "g").collect()}
    for r in points.distance_statistics(df, "g", block=7).collect():
        for name in ("Mean_dist", "Min_dist", "Max_dist", "Std_dist"):
            assert r[name] == pytest.approx(whole[r.ID][name])
    assert whole["one"].Mean_dist is None
    assert (whole[None].Mean_dist, whole[None].N_pnts) == (5.0, 2)
