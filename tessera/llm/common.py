"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.ordered import materialise as cut, shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths made by this process in the shared folder and not yet removed.
WORK: list[str] = []


def work_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    WORK.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return WORK[-1]


def discard(spark: SparkSession, kept: set[str] | frozenset[str] = frozenset()) -> None:
    """Removes all of :data:`WORK` but ``kept``; for when nothing reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in WORK if p not in kept]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        WORK.remove(path)


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A materialised table of few narrow columns: marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def fold(id_column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and the n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return raw[first : int(offsets[-1])], offsets - first


def row_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cut lineage, columnar and compressed."""
    spark = df.sparkSession
    where = work_path(spark, what)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def keep_rows(df: DataFrame, text: str, start: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], limit: int) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns.

    ``start()`` gives a task's test: from the bytes and offsets of a group of texts,
    of about ``limit`` bytes, whether each passes."""
    place = df.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = start()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(place))
            masks = [test(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_ranges(offsets, limit)]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return df.mapInArrow(kernel, df.schema)
