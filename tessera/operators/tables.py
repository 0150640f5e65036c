"""Frequency tables, cross-tabulations and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import medians


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, so that statistics skip it."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def unique_name(df: DataFrame, base: str, on_conflict: str = "suffix") -> str:
    """A name for a new column: ``base``, or with a suffix where the table has it already."""
    if on_conflict == "replace" or base not in df.columns:
        return base
    n = 1
    while f"{base}_{n}" in df.columns:
        n += 1
    return f"{base}_{n}"


def has_nulls(column: str) -> Column:
    """Whether a float value is NULL or NaN."""
    return F.col(column).isNull() | F.isnan(F.col(column))


def field_info(df: DataFrame) -> DataFrame:
    """One row for each field: name, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def frequency(df: DataFrame, class_fields: list[str], stat_field: str | None = None) -> DataFrame:
    """Counts of each combination; with ``stat_field`` also its sum (0 where all are null), null count, min, mean and max."""
    aggs = [F.count(F.lit(1)).alias("Counts")]
    if stat_field:
        c = F.col(stat_field)
        aggs += [
            F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{stat_field}_sums"),
            F.count_if(c.isNull()).alias(f"{stat_field}_NaN"),
            F.min(c).alias(f"{stat_field}_min"),
            F.avg(c).alias(f"{stat_field}_mean"),
            F.max(c).alias(f"{stat_field}_max"),
        ]
    return df.groupBy(*class_fields).agg(*aggs)


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Count of each combination that occurs."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("Count"))


def crosstab_dense(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """A row for each row class, a column for each of ``values``, zeros filled in, and ``Total``."""
    out = df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(str(v)) for v in values], F.count(F.lit(1)).alias("Total"))
    return out


def crosstab_totals(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of combinations, of rows, of columns and of all; ``level`` is the grouping id, since null is a class too."""
    return df.cube(row, col).agg(F.count(F.lit(1)).alias("Count"), F.grouping_id().cast("long").alias("level"))


def field_statistics(df: DataFrame, fields: list[str], name: str = "Field", with_n: bool = True) -> DataFrame:
    """One row for each field: N, sum, min, max, median, mean, population deviation and variance, skewness and
    kurtosis (raw, 3 for a normal). Nulls and NaN are skipped."""
    long = normalise_nulls(df.select(*[F.col(f).cast("double").alias(f) for f in fields])).unpivot([], fields, name, "v")
    v = F.col("v")
    aggs = [
        F.count(v).alias("N"),
        F.sum(v).alias("Sum"),
        F.min(v).alias("Min"),
        F.max(v).alias("Max"),
        F.lit(None).cast("double").alias("Med"),
        F.avg(v).alias("Avg"),
        F.stddev_pop(v).alias("Std"),
        F.var_pop(v).alias("Var"),
        F.skewness(v).alias("Skew"),
        (F.kurtosis(v) + 3).alias("Kurt"),
    ]
    out = long.groupBy(name).agg(*(aggs if with_n else aggs[1:]))
    middle = medians(long, "v", name).select(F.col(name).alias("__field"), "median")
    return out.join(F.broadcast(middle), F.col(name) == F.col("__field"), "left").withColumn("Med", F.col("median")).drop("__field", "median")


def row_skew_kurt(fields: list[str], moment: str = "skew") -> Column:
    """Skewness or kurtosis across a row's fields."""
    values = F.array(*[F.col(f).cast("double") for f in fields])
    n = F.lit(float(len(fields)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    central = lambda k: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(float(k)))) / n
    power = {"skew": (3, 1.5), "kurt": (4, 2.0)}[moment]
    return central(power[0]) / F.pow(central(2), F.lit(power[1]))


def geometric_mean(column: str) -> Column:
    """Aggregate; positive values only."""
    return F.exp(F.avg(F.ln(F.col(column))))


def extent(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates: left, bottom, right, top."""
    return [F.min(x).alias("L"), F.min(y).alias("B"), F.max(x).alias("R"), F.max(y).alias("T")]


def mean_center(df: DataFrame, group: list[str], x: str = "x", y: str = "y", distinct: bool = True) -> DataFrame:
    """Mean of the (distinct) points of each group."""
    points = df.select(*group, x, y)
    return (points.distinct() if distinct else points).groupBy(*group).agg(F.avg(x).alias("CentX"), F.avg(y).alias("CentY"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts between consecutive edges; the last bin has its upper edge too."""
    v = F.col(column)
    which = F.when((v >= edges[0]) & (v <= edges[-1]), sum(((v >= e).cast("int") for e in edges[1:-1]), F.lit(0)))
    return df.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("Count"))


def extend_table(df: DataFrame, other: DataFrame, key: str, other_key: str, replace: bool = False) -> DataFrame:
    """Left join of ``other``'s columns on the key; columns of the same name are replaced or get a suffix."""
    other = other.withColumnRenamed(other_key, "__key")
    shared = [c for c in other.columns if c != "__key" and c in df.columns]
    if replace:
        df = df.drop(*shared)
    else:
        other = other.withColumnsRenamed({c: unique_name(df, c) for c in shared})
    return df.join(other, df[key] == F.col("__key"), "left").drop("__key")


def transpose_head(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows as columns: one output row for each field, values as text."""
    head = df.orderBy(*order).limit(rows)
    text = head.select([F.col(c).cast("string").alias(c) for c in df.columns]).collect()
    data = [(c, *[r[c] for r in text]) for c in df.columns]
    return df.sparkSession.createDataFrame(data, ", ".join(["field string", *[f"r{i} string" for i in range(len(text))]]))
