"""Rank, cumulative, difference, label, run-length, moving-window and classification operators.

``order`` names the columns that fix the row order, unique together. ``partition_by``
restarts an operator in each group; without it the whole table is one sequence, and the
operators go through :class:`tessera.plans.ordered.Ordered`, never through one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.ordered import BLOCK, Ordered, medians, numbered, sliding

STATISTICS = {"max": F.max, "mean": F.avg, "median": F.median, "min": F.min}


def _window(order: list[str], partition_by: list[str]) -> Window:
    return Window.partitionBy(*partition_by).orderBy(*order)


def rank_min(df: DataFrame, field: str, out: str = "Rank", partition_by: list[str] | None = None) -> DataFrame:
    """How many values are smaller, from 0, equal values alike."""
    if partition_by:
        return df.withColumn(out, (F.rank().over(_window([field], partition_by)) - 1).cast("long"))
    # counts by value are ordered and summed, so ties need no task of their own
    counts = df.groupBy(F.col(field).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    before = Ordered(counts, ["__v"]).with_sum("__upto", F.col("__n")).df
    ranks = before.select(F.struct("__v").alias("__key"), (F.col("__upto") - F.col("__n")).alias(out))
    return df.drop(out).join(ranks, F.struct(F.col(field).alias("__v")) == F.col("__key")).drop("__key")


def rank_ordinal(df: DataFrame, fields: list[str], order: list[str], out: str = "Rank", partition_by: list[str] | None = None) -> DataFrame:
    """1..N by the fields, then by ``order``."""
    return numbered(df, [*fields, *[c for c in order if c not in fields]], out, partition_by)


def cumulative_sum(df: DataFrame, field: str, order: list[str], out: str = "cumsum", partition_by: list[str] | None = None) -> DataFrame:
    """Running total; null adds 0 and shows the carried total."""
    if partition_by:
        return Ordered(df, [*partition_by, *order]).with_sum_by(out, F.col(field), partition_by).df.withColumn(out, F.coalesce(F.col(out), F.lit(0)))
    return Ordered(df, order).with_sum(out, F.col(field)).df.withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def _with_aggregate(df: DataFrame, aggregates: dict[str, Column], partition_by: list[str] | None) -> DataFrame:
    """``df`` with aggregates of the whole table (one row, broadcast) or of each group."""
    if partition_by:
        return df.withColumns({n: a.over(Window.partitionBy(*partition_by)) for n, a in aggregates.items()})
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def difference_from(df: DataFrame, field: str, statistic: str | float, out: str = "diff", partition_by: list[str] | None = None) -> DataFrame:
    """Value minus the max, mean, median or min, or minus a constant. Null in, null out."""
    if isinstance(statistic, (int, float)):
        return df.withColumn(out, F.col(field) - F.lit(statistic))
    if statistic == "median" and not partition_by:
        middle = medians(df.select(F.lit(0).alias("__g"), F.col(field).cast("double").alias("__v")), "__v", "__g").select(F.col("median").alias("__s"))
        whole = middle.agg(F.max("__s").alias("__s"))
        return df.crossJoin(F.broadcast(whole)).withColumn(out, F.col(field) - F.col("__s")).drop("__s")
    return _with_aggregate(df, {"__s": STATISTICS[statistic](F.col(field))}, partition_by).withColumn(out, F.col(field) - F.col("__s")).drop("__s")


def percent(df: DataFrame, field: str, out: str = "percent", partition_by: list[str] | None = None) -> DataFrame:
    """Share of the total, in percent."""
    return _with_aggregate(df, {"__s": F.sum(field)}, partition_by).withColumn(out, 100 * F.col(field) / F.col("__s")).drop("__s")


def z_score(df: DataFrame, field: str, out: str = "z", partition_by: list[str] | None = None) -> DataFrame:
    """Deviations from the mean, by the population deviation."""
    both = {"__m": F.avg(field), "__d": F.stddev_pop(field)}
    return _with_aggregate(df, both, partition_by).withColumn(out, F.when(F.col("__d") != 0, (F.col(field) - F.col("__m")) / F.col("__d"))).drop("__m", "__d")


def previous(df: DataFrame, value: Column, order: list[str], out: str, default: object = None, partition_by: list[str] | None = None) -> DataFrame:
    """The value of the row before."""
    if partition_by:
        return df.withColumn(out, F.lag(value, 1, default).over(_window(order, partition_by)))
    return Ordered(df, order).with_lag(out, value, default).df


def sequential_difference(df: DataFrame, field: str, order: list[str], out: str = "diff", partition_by: list[str] | None = None) -> DataFrame:
    """Value minus the one before; the first row has 0."""
    marked = previous(df, F.struct(F.col(field).alias("v")), order, "__p", None, partition_by)
    return marked.withColumn(out, F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.col(field) - F.col("__p.v"))).drop("__p")


def occurrence(df: DataFrame, field: str, order: list[str], out: str = "k") -> DataFrame:
    """1 for the first row with a value, 2 for its second, ..."""
    return Ordered(df, [field, *[c for c in order if c != field]]).with_sum_by(out, F.lit(1).cast("long"), [field]).df


def sequential_text(df: DataFrame, field: str, order: list[str], out: str = "label", style: str = "text") -> DataFrame:
    """Labels from a value and its occurrence.

    ``number``: value and a 0-based count of two digits or more. ``text``: ``value_k``,
    0-based, zero-padded to the digits of the largest count. ``count``: ``value_k``,
    1-based, three digits or more.
    """
    k = occurrence(df, field, order, "__k")
    pad = lambda n, width: F.when(F.length(n) < width, F.lpad(n, 20, "0").substr(F.lit(21) - width, width)).otherwise(n)
    value = F.col(field).cast("string")
    if style == "number":
        label = F.concat(value, pad((F.col("__k") - 1).cast("string"), F.lit(2)))
    elif style == "count":
        label = F.concat(value, F.lit("_"), pad(F.col("__k").cast("string"), F.lit(3)))
    else:
        largest = df.groupBy(field).count().agg(F.max("count").alias("__most"))
        k = k.crossJoin(F.broadcast(largest))
        label = F.concat(value, F.lit("_"), pad((F.col("__k") - 1).cast("string"), F.length(F.col("__most").cast("string"))))
    return k.withColumn(out, label).drop("__k", "__most")


def sequential_duplicate(df: DataFrame, field: str, order: list[str], out: str = "dup", partition_by: list[str] | None = None) -> DataFrame:
    """1 where the value equals the one before (null equals null); before the first row stands the empty text."""
    text = df.schema[field].dataType.typeName() == "string"
    marked = previous(df, F.col(field), order, "__p", "" if text else None, partition_by)
    if not text:
        marked = previous(marked, F.lit(1), order, "__any", None, partition_by)
        return marked.withColumn(out, (F.col(field).eqNullSafe(F.col("__p")) & F.col("__any").isNotNull()).cast("int")).drop("__p", "__any")
    return marked.withColumn(out, F.col(field).eqNullSafe(F.col("__p")).cast("int")).drop("__p")


def sequence_group(df: DataFrame, number: str, every: int, order: list[str], out: str = "group", partition_by: list[str] | None = None) -> DataFrame:
    """A counter that goes up where ``number`` is a multiple of ``every``."""
    step = F.coalesce((F.col(number) % every == 0).cast("long"), F.lit(0))
    if partition_by:
        return df.withColumn(out, F.sum(step).over(_window(order, partition_by).rowsBetween(Window.unboundedPreceding, 0)))
    return Ordered(df, order).with_sum(out, step).df


def run_lengths(df: DataFrame, field: str, order: list[str], step: float = 0) -> DataFrame:
    """Runs of values that go up by ``step`` (0: equal values, also for text).

    ``ID`` from 0, ``Value`` of the first row, ``Count``, ``From_`` and ``To_``: 0-based
    positions, the second exclusive."""
    rows = Ordered(df.select(field, *[c for c in order if c != field]), order).with_number("__n").with_lag("__p", F.struct(F.col(field).alias("v")))
    value, before = F.col(field), F.col("__p.v")
    goes_on = value.eqNullSafe(before) if not step else F.coalesce(value - before == step, F.lit(False))
    rows = rows.next(rows.rows.withColumn("__new", F.when(F.col("__p").isNull() | ~goes_on, 1).otherwise(0)))
    runs = rows.with_sum("__run", F.col("__new")).df.groupBy("__run").agg(F.min_by(field, "__n").alias("Value"), F.count(F.lit(1)).alias("Count"), (F.min("__n") - 1).alias("From_"), F.max("__n").alias("To_"))
    return runs.select((F.col("__run") - 1).cast("long").alias("ID"), "Value", "Count", "From_", "To_")


def moving_window(df: DataFrame, field: str, order: list[str], func: str, size: int = 3, out: str = "moved", partition_by: list[str] | None = None) -> DataFrame:
    """Mean, median, min, max, sum, mode or trend of a centred window of odd ``size``; null at the edges.

    Nulls are skipped. Mode takes the smallest of the most frequent values; trend is the
    mode of the signs of the differences inside the window."""
    if size < 3 or size % 2 == 0:
        raise ValueError("the window's size has to be odd and at least 3")
    half, value = size // 2, F.col(field).cast("double")
    simple = {
        "mean": lambda w: F.avg(value).over(w),
        "median": lambda w: F.percentile(value, F.lit(0.5)).over(w),
        "min": lambda w: F.min(value).over(w),
        "max": lambda w: F.max(value).over(w),
        "sum": lambda w: F.sum(value).over(w),
        "mode": lambda w: F.mode(value, True).over(w),
    }
    whole = lambda w: F.count(F.lit(1)).over(w)
    if func == "trend":
        values = lambda w: F.collect_list(F.struct(value.alias("v"))).over(w)
        out_df = sliding(df, order, half, {"__list": values, "__rows": whole}, partition_by)
        v = F.transform("__list", lambda s: s["v"])
        signs = F.filter(F.zip_with(F.slice(v, 2, size), F.slice(v, 1, size - 1), lambda a, b: F.signum(a - b)), lambda s: s.isNotNull())
        times = lambda k: F.size(F.filter(signs, lambda s: s == k))
        most = F.greatest(times(-1), times(0), times(1))
        trend = F.when(F.size(signs) == 0, None).when(times(-1) == most, -1.0).when(times(0) == most, 0.0).otherwise(1.0)
        return out_df.withColumn(out, F.when(F.col("__rows") == size, trend)).drop("__list", "__rows")
    out_df = sliding(df, order, half, {out: simple[func], "__rows": whole}, partition_by)
    return out_df.withColumn(out, F.when(F.col("__rows") == size, F.col(out))).drop("__rows")


def nested_mean_breaks(df: DataFrame, field: str, least: int = 3, most: int = 9) -> list[float]:
    """Class breaks by means of means: the mean, then outwards on both sides the mean of what lies beyond, at most ``most + 2``.

    Each round is one aggregation; only counts and means come to the driver."""
    v = F.col(field)
    mean = df.agg(F.avg(v)).first()[0]
    if mean is None:
        return []
    high = low = mean
    breaks = [mean]
    side = lambda cond: df.where(cond).agg(F.count(v), F.avg(v)).first()
    n_high, mean_high = side(v > high)
    n_low, mean_low = side(v <= low)
    while True:
        breaks += [m for n, m in ((n_high, mean_high), (n_low, mean_low)) if n]
        if len(breaks) > most or mean_high is None or mean_low is None:
            break
        high, low = mean_high, mean_low
        n_high, mean_high = side(v > high)
        n_low, mean_low = side(v <= low)
        if n_high <= least or n_low <= least:
            break
    return sorted(set(breaks))


def classify(df: DataFrame, field: str, breaks: list[float], out: str = "class") -> DataFrame:
    """How many breaks are at or below the value."""
    return df.withColumn(out, sum(((F.col(field) >= b).cast("int") for b in breaks), F.lit(0)))


def cumulative_with_reset(df: DataFrame, field: str, order: list[str], partition_by: list[str], out: str = "cumulative") -> DataFrame:
    """Running total that starts anew at the value once it has been negative; null adds 0 and shows the carried total.

    What a stretch of rows does to the total depends on all of its values, so the stretches
    of a group can't be summed apart: a partition is required, and each group is read in
    order by one task, row by row, with the total as its only state."""
    names = [*partition_by, *order, field]
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in names[:-1]]
    rows = df.select(*partition_by, *order, F.col(field).cast("double").alias(field)).repartition(*partition_by).sortWithinPartitions(*partition_by, *order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0.0
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[: len(partition_by)]), strict=True)
            sums = []
            for key, v in zip(keys, batch.column(len(names) - 1).to_pylist(), strict=True):
                if key != group:
                    group, total = key, 0.0
                total = (v or 0.0) + (total if total >= 0 else 0.0)
                sums.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.float64())], [*names, out])

    return rows.mapInArrow(kernel, ", ".join([*kinds, f"{field} double", f"{out} double"]))


def distance_to_previous(df: DataFrame, order: list[str], x: str = "x", y: str = "y", partition_by: list[str] | None = None) -> DataFrame:
    """Adds ``dist`` (0 for the first), ``cumu_dist``, ``angle`` (x axis, -180 to 180) and ``azimuth`` (from north) of the step from the row before."""
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    if partition_by:
        rows = previous(df, point, order, "__p", None, partition_by)
    else:
        chain = Ordered(df, order).with_lag("__p", point)
        rows = chain.rows
    dx, dy = F.col(x) - F.col("__p.x"), F.col(y) - F.col("__p.y")
    angle = F.coalesce(F.degrees(F.atan2(dy, dx)), F.lit(0.0))
    first = F.col("__p").isNull()
    rows = rows.withColumns({"dist": F.coalesce(F.hypot(dx, dy), F.lit(0.0)), "angle": angle, "azimuth": F.when(first, F.lit(0.0)).otherwise(F.pmod(F.lit(450.0) - angle, F.lit(360.0)))}).drop("__p")
    if partition_by:
        return rows.withColumn("cumu_dist", F.sum("dist").over(_window(order, partition_by).rowsBetween(Window.unboundedPreceding, 0)))
    return chain.next(rows).with_sum("cumu_dist", F.col("dist")).df.drop(BLOCK)


def focal_window(cells: DataFrame, height: int, width: int, aggregate: Column, row: str = "row", col: str = "col", value: str = "value", step: tuple[int, int] = (1, 1)) -> DataFrame:
    """``aggregate`` of ``value`` over each whole window of ``height`` x ``width`` cells; ``row`` and ``col`` are its upper left cell."""
    out = focal_cells(cells.select(F.col(row).alias("row"), F.col(col).alias("col"), value), {"row": height, "col": width}, aggregate, {"row": step[0], "col": step[1]})
    return out.select("row", "col", "focal")


def focal_cells(cells: DataFrame, window: dict[str, int], aggregate: Column, step: dict[str, int] | None = None) -> DataFrame:
    """``aggregate`` over each whole window of the lengths in ``window``, by axis, in any number of axes; no padding at the edges.

    The axes' columns hold the window's least cell, every ``step``-th from 0. Each cell goes
    to the windows that hold it, so partial aggregates are made before the exchange."""
    for axis, length in window.items():
        cells = cells.withColumn(axis, F.explode(F.sequence(F.col(axis) - F.lit(length - 1), F.col(axis))))
        cells = cells.where((F.col(axis) >= 0) & (F.col(axis) % (step or {}).get(axis, 1) == 0))
    out = cells.groupBy(*window).agg(aggregate.alias("focal"), F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == math.prod(window.values())).select(*window, "focal")
