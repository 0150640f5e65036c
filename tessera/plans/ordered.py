"""Windows over a whole table's order without gathering it in one task.

``Ordered`` deals the rows in ranges of the order (blocks), materialised once so that the
blocks stay the same. A window then runs inside each block, and what comes before the
block (row count, running sums, last value) is carried in from a table with one row for
each block, the only thing that a single task sees.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Only in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


class Ordered:
    """Rows in the order of ``order``, which has to be unique for ordinals to be deterministic."""

    def __init__(self, df: DataFrame, order: list[str], blocks: int | None = None):
        self.order = list(order)
        if blocks == 0:
            self.rows = df
            return
        n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *as_columns(self.order)).withColumn(BLOCK, F.spark_partition_id())
        self.rows = materialise(dealt)

    def next(self, rows: DataFrame) -> Ordered:
        out = Ordered(rows, self.order, blocks=0)
        return out

    @property
    def window(self) -> Window:
        return Window.partitionBy(BLOCK).orderBy(*as_columns(self.order))

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(BLOCK)

    def carried(self, totals: Column, combine) -> DataFrame:
        """(block, carry): ``combine`` of the totals of all blocks before each."""
        table = self.rows.groupBy(BLOCK).agg(totals.alias("__total"))
        before = Window.orderBy(BLOCK)
        return table.select(F.col(BLOCK).alias("__b"), combine(F.col("__total"), before).alias("__carry"))

    def join_carry(self, carry: DataFrame) -> DataFrame:
        # one row for each block, and there are at most as many blocks as shuffle partitions
        return self.rows.join(F.broadcast(carry), F.col(BLOCK) == F.col("__b"), "left").drop("__b")

    def with_sum(self, name: str, value: Column) -> Ordered:
        """Running sum up to and with the row; nulls add nothing, and before any value it is null."""
        rows = self.rows.withColumn("__value", value)
        this = self.next(rows)
        carry = this.carried(F.sum("__value"), lambda t, w: F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        here = F.sum("__value").over(this.window.rowsBetween(Window.unboundedPreceding, 0))
        total = F.when(here.isNotNull() | F.col("__carry").isNotNull(), F.coalesce(F.col("__carry"), F.lit(0)) + F.coalesce(here, F.lit(0)))
        return self.next(this.join_carry(carry).withColumn(name, total).drop("__value", "__carry"))

    def with_sum_by(self, name: str, value: Column, by: list[str]) -> Ordered:
        """Running sum that starts anew with each value of ``by``, the columns by which the order begins.

        A value may fill many blocks: what comes before a block is carried for the first and
        the last value of each, so there are two rows a block at most, however hot a value is."""
        key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])
        this = self.next(self.rows.withColumns({"__value": value, "__key": key}))
        edges = this.rows.groupBy(F.col(BLOCK).alias("__b")).agg(F.min("__key").alias("__lo"), F.max("__key").alias("__hi"))
        at_edge = this.rows.join(F.broadcast(edges), F.col(BLOCK) == F.col("__b")).where((F.col("__key") == F.col("__lo")) | (F.col("__key") == F.col("__hi")))
        sums = at_edge.groupBy(F.col(BLOCK).alias("__b"), F.col("__key").alias("__edge")).agg(F.sum("__value").alias("__total"))
        before = Window.partitionBy("__edge").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select("__b", "__edge", F.sum("__total").over(before).alias("__carry"))
        here = F.sum("__value").over(Window.partitionBy(BLOCK, "__key").orderBy(*as_columns(self.order)).rowsBetween(Window.unboundedPreceding, 0))
        total = F.when(here.isNotNull() | F.col("__carry").isNotNull(), F.coalesce(F.col("__carry"), F.lit(0)) + F.coalesce(here, F.lit(0)))
        rows = this.rows.join(F.broadcast(carry), (F.col(BLOCK) == F.col("__b")) & (F.col("__key") == F.col("__edge")), "left")
        return self.next(rows.withColumn(name, total).drop("__value", "__carry", "__key", "__b", "__edge"))

    def with_number(self, name: str) -> Ordered:
        """1, 2, ... in order."""
        carry = self.carried(F.count(F.lit(1)), lambda t, w: F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        number = F.row_number().over(self.window).cast("long") + F.coalesce(F.col("__carry"), F.lit(0))
        return self.next(self.join_carry(carry).withColumn(name, number).drop("__carry"))

    def with_lag(self, name: str, value: Column, default: object = None) -> Ordered:
        """The value of the row before; ``default`` for the first row only."""
        rows = self.rows.withColumn("__value", F.struct(value.alias("v")))
        this = self.next(rows)
        key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(as_columns(self.order))])
        carry = this.carried(F.max_by("__value", key), lambda t, w: F.lag(t).over(w))
        before = F.coalesce(F.lag("__value").over(this.window), F.col("__carry"))
        kind = rows.schema["__value"].dataType["v"].dataType
        out = F.when(before.isNotNull(), before["v"]).otherwise(F.lit(default).cast(kind))
        return self.next(this.join_carry(carry).withColumn(name, out).drop("__value", "__carry"))


def numbered(df: DataFrame, order: list[str], name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` with ordinals 1, 2, ..., whole or by partition."""
    if partition_by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*as_columns(order))).cast("long"))
    return Ordered(df, order).with_number(name).df


def medians(df: DataFrame, value: str, by: str) -> DataFrame:
    """(``by``, ``median``) of values that aren't null. The values are ranked in ranges, so no task sees all of a group's;
    groups have to be few, for their counts are broadcast."""
    known = df.where(F.col(value).isNotNull()).select(by, value)
    ranked = Ordered(known, [by, value]).with_sum_by("__rank", F.lit(1).cast("long"), [by]).df
    counts = known.groupBy(F.struct(F.col(by).alias("k")).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    both = ranked.join(F.broadcast(counts), F.struct(F.col(by).alias("k")) == F.col("__k"))
    middle = both.where(F.col("__rank").isin(F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)))
    return middle.groupBy(by).agg(F.avg(value).alias("median"))


def sliding(df: DataFrame, order: list[str], half: int, columns: dict, partition_by: list[str] | None = None, chunk: int = 100_000) -> DataFrame:
    """Columns over the ``half`` rows before and after each row.

    ``columns``: name -> function from the framed window to a Column. Without partitions
    the rows are numbered and dealt in chunks, and each chunk is lent the ``half`` rows at
    its borders, so a frame never needs another task.
    """
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*as_columns(order)).rowsBetween(-half, half)
        return df.withColumns({n: f(w) for n, f in columns.items()})
    rows = Ordered(df, order).with_number("__n").rows.drop(BLOCK)
    own = F.floor((F.col("__n") - 1) / chunk)
    first, last = F.floor((F.col("__n") - 1 - half) / chunk), F.floor((F.col("__n") - 1 + half) / chunk)
    rows = rows.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    w = Window.partitionBy("__chunk").orderBy("__n").rowsBetween(-half, half)
    return rows.withColumns({n: f(w) for n, f in columns.items()}).where("__own = __chunk").drop("__n", "__own", "__chunk")
