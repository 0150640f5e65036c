"""Ordinal quality classifier on hashed text.

Cumulative-link (proportional-odds) regression: one weight for each hashed feature,
shared by all grades, and ordered thresholds between the grades,
``P(grade <= k) = sigmoid(threshold_k - score)``. Predictions are the expected grade
and the tail probability of reaching a grade, by which documents are selected.

Features of a text, each counted once: hashes of its words (A-Z lower-cased), of their
first 4 and 6 bytes, of two closing bytes that aren't letters or digits, the share of
distinct words in tenths, and the number of words by powers of two.

Fitting takes a bounded sample (``per_grade`` ids of each grade at most, those with the
least hashes, and whole texts); scoring takes all rows and whole texts. Edge cases: rows
with a null text or grade aren't fitted; a null or empty text is scored by its length
feature alone; with fewer than two grades in the sample every row gets the same
prediction; an id that repeats is fitted once, by its least list of features, and scored
row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep_rows, row_ranges, text_bytes
from tessera.llm.quality_rules import BLANK, GROUP_BYTES, mix, occurrences, running_hash, span_hash

BITS = 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    """``grades`` ascending; ``thresholds`` one fewer; ``weights`` by bucket, most of them zero."""

    grades: tuple[float, ...]
    thresholds: np.ndarray
    weights: np.ndarray


def hashed_features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs of one group, without repeats; only buckets in ``wanted`` if given."""
    n = len(offsets) - 1
    raw = LOWER[raw]
    word_byte = ~BLANK[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(word_byte & (~np.concatenate(([False], word_byte))[:-1] | edge[:-1]))
    end = np.flatnonzero(word_byte & (~np.concatenate((word_byte, [False]))[1:] | edge[1:])) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    text_of = np.repeat(np.arange(n), counts)
    total, down = running_hash(raw)
    word = span_hash(total, down, start, end)
    _, earlier = occurrences(word ^ mix(text_of.astype(np.uint64) + np.uint64(1)))
    new = np.flatnonzero(~earlier)
    start, end, word, text = start[new], end[new], word[new], text_of[new]
    distinct = np.bincount(text, minlength=n)[:n]
    parts = [(text, word ^ np.uint64(1))]
    for k in (4, 6):
        longer = end - start > k
        parts.append((text[longer], span_hash(total, down, start[longer], start[longer] + k) ^ np.uint64(k)))
    closing = (end - start > 2) & ~PLAIN[raw[end - 1]] & ~PLAIN[raw[np.maximum(end - 2, 0)]] if len(end) else np.zeros(0, bool)
    parts.append((text[closing], span_hash(total, down, end[closing] - 2, end[closing]) ^ np.uint64(9)))
    tenth = (10 * distinct // np.maximum(counts, 1)).astype(np.uint64)
    size = np.frexp(counts.astype(np.float64))[1].astype(np.uint64)
    parts += [(np.arange(n), mix(tenth + np.uint64(1000))), (np.arange(n), mix(size + np.uint64(2000)))]
    texts = np.concatenate([t for t, _ in parts])
    buckets = (mix(np.concatenate([h for _, h in parts])) >> np.uint64(64 - BITS)).astype(np.int64)
    if wanted is not None:
        some = wanted[buckets]
        texts, buckets = texts[some], buckets[some]
    pairs = np.unique(texts << BITS | buckets)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def feature_rows(df: DataFrame, id_column: str, text: str, grade: str) -> DataFrame:
    """The id, ``grade`` and ``buckets`` of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for a, b in row_ranges(offsets, GROUP_BYTES):
                texts, buckets = hashed_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cuts = np.searchsorted(texts, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], [id_column, "grade", "buckets"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, F.col(grade).cast("double").alias("grade"), text).mapInArrow(kernel, f"{id_column} {kind}, grade double, buckets array<int>")


def training_sample(docs: DataFrame, marks: DataFrame, id_column: str, text: str, grade: str, per_grade: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[float, int]]:
    """Grades, row cuts and buckets of the sample, and how many rows each grade has in all.

    The ids are chosen among the marks, so what is broadcast has at most ``per_grade`` rows
    of an id and a grade for each grade, and no text is shuffled."""
    key = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30))
    marks = marks.where(F.col(grade).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(grade).cast("double").alias("__grade"))
    counts = dict(marks.groupBy("__grade").count().collect())
    bound = F.lit(0.0)
    for g, n in counts.items():
        bound = F.when(F.col("__grade") == g, F.lit(2.0 * per_grade * (1 << 30) / n)).otherwise(bound)
    near = marks.withColumn("__k", key).where(F.col("__k") < bound)
    chosen = near.withColumn("__r", F.row_number().over(Window.partitionBy("__grade").orderBy("__k", "__id"))).where(F.col("__r") <= per_grade).select("__id", "__grade")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("__key"), F.col(text).alias("__text"))
    rows = feature_rows(texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")), "__key", "__text", "__grade")
    rows = rows.groupBy("__key", "grade").agg(F.min("buckets").alias("buckets")).toArrow().sort_by("__key")
    lists = rows["buckets"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return rows["grade"].to_numpy(), cuts, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def pick_features(y: np.ndarray, rows: np.ndarray, buckets: np.ndarray, least: int, z: float) -> np.ndarray:
    """Buckets of at least ``least`` rows whose rows lean to one side of a threshold by ``z`` deviations."""
    df = np.bincount(buckets, minlength=1 << BITS)
    keep = np.zeros(1 << BITS, dtype=bool)
    for k in range(1, int(y.max()) + 1):
        high = (y >= k).astype(np.float64)
        p = high.mean()
        if 0 < p < 1:
            got = np.bincount(buckets, weights=high[rows], minlength=1 << BITS)
            keep |= np.abs(got - df * p) >= z * np.sqrt(np.maximum(df * p * (1 - p), 1e-9))
    return keep & (df >= least)


def fit(y: np.ndarray, cuts: np.ndarray, buckets: np.ndarray, counts: dict[float, int], rounds: int = 250, rate: float = 0.2, l1: float = 4e-5, least: int = 4, z: float = 3.0) -> Model:
    """Proximal gradient steps with a rate for each weight; rows weigh so that grades have their shares of all rows."""
    grades = tuple(sorted(set(y.tolist())))
    weights = np.zeros(1 << BITS)
    if len(grades) < 2:
        return Model(grades or (0.0,), np.zeros(0), weights)
    level = np.searchsorted(grades, y)
    rows = np.repeat(np.arange(len(y)), np.diff(cuts))
    keep = pick_features(level, rows, buckets, least, z)
    columns = np.flatnonzero(keep)
    number = np.full(1 << BITS, -1)
    number[columns] = np.arange(len(columns))
    some = keep[buckets]
    rows, cols = rows[some], number[buckets[some]]
    seen = np.bincount(level, minlength=len(grades))
    total = np.array([max(counts.get(g, 0), 1) for g in grades], dtype=np.float64)
    share = total / total.sum()
    cost = (share / seen)[level]
    below = np.cumsum(share)[:-1]
    theta = np.log(below / (1 - below))
    w = np.zeros(len(columns))
    grown, grown_theta = np.full(len(columns), 1e-12), np.full(len(theta), 1e-12)
    for _ in range(rounds):
        eta = np.bincount(rows, weights=w[cols], minlength=len(y))
        cum = 1 / (1 + np.exp(-np.clip(np.concatenate(([-np.inf], theta, [np.inf]))[None, :] - eta[:, None], -40, 40)))
        cum[:, 0], cum[:, -1] = 0, 1
        hi, lo = cum[np.arange(len(y)), level + 1], cum[np.arange(len(y)), level]
        p = np.maximum(hi - lo, 1e-9)
        g_eta = -cost * (hi + lo - 1)
        g = np.bincount(cols, weights=g_eta[rows], minlength=len(columns))
        up, dn = cost * hi * (1 - hi) / p, cost * lo * (1 - lo) / p
        g_theta = np.array([dn[level == k + 1].sum() - up[level == k].sum() for k in range(len(theta))])
        grown += g * g
        grown_theta += g_theta * g_theta
        step = rate / np.sqrt(grown)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.maximum.accumulate(theta - rate * g_theta / np.sqrt(grown_theta))
    weights[columns] = w
    return Model(grades, theta, weights)


def fit_classifier(docs: DataFrame, marks: DataFrame, id_column: str = "doc_id", text: str = "text", grade: str = "grade", per_grade: int = 2500, **options: float) -> Model:
    """A model of the rows of ``docs`` that ``marks`` (id, grade; one row for each id) grades."""
    y, cuts, buckets, counts = training_sample(docs, marks, id_column, text, grade, per_grade)
    return fit(y, cuts, buckets, counts, **options)


def probabilities(model: Model, eta: np.ndarray) -> np.ndarray:
    """P(grade >= k) for every grade k, the first of which is 1."""
    tail = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - eta[:, None], -40, 40)))
    return np.concatenate((np.ones((len(eta), 1)), tail), axis=1)


def grade_texts(df: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", least_grade: float | None = None, least_probability: float = 0.5) -> DataFrame:
    """The id, ``score``, ``expected_grade``, ``tail_probability`` (of ``least_grade`` or
    better, the best grade if not given) and ``selected``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [id_column, "score", "expected_grade", "tail_probability", "selected"]
    wanted_grade = len(model.grades) - 1 if least_grade is None else int(np.searchsorted(model.grades, least_grade))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        used = m.weights != 0
        steps = np.diff(np.array(m.grades))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in row_ranges(offsets, GROUP_BYTES):
                texts, buckets = hashed_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], used)
                eta = np.bincount(texts, weights=m.weights[buckets], minlength=b - a).astype(np.float64)
                tail = probabilities(m, eta)
                expected = m.grades[0] + tail[:, 1:] @ steps
                reach = tail[:, wanted_grade]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(eta), pa.array(expected), pa.array(reach), pa.array(reach >= least_probability)], names)

    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, score double, expected_grade double, tail_probability double, selected boolean"
    return df.select(id_column, text).mapInArrow(kernel, schema)


def keep_texts(df: DataFrame, model: Model, text: str = "text", least_grade: float | None = None, least_probability: float = 0.5) -> DataFrame:
    """The rows that :func:`grade_texts` selects, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    wanted_grade = len(model.grades) - 1 if least_grade is None else int(np.searchsorted(model.grades, least_grade))

    def start() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        m = shared.value
        used = m.weights != 0

        def test(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            texts, buckets = hashed_features(raw, offsets, used)
            eta = np.bincount(texts, weights=m.weights[buckets], minlength=len(offsets) - 1).astype(np.float64)
            return probabilities(m, eta)[:, wanted_grade] >= least_probability

        return test

    return keep_rows(df, text, start, GROUP_BYTES)


def grades_of(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids and grades: 0 toxic, 1 of low quality, 2 good; none where a label is null.

    One row for each id: labels that repeat count with their lowest grade."""
    toxic, quality = F.col("toxic"), F.col("quality")
    grade = F.when(toxic == 1, 0).when(toxic.isNull(), None).when(quality == 0, 1).when(quality == 1, 2)
    return labels.select(F.col(id_column), grade.alias("grade")).where("grade is not null").groupBy(id_column).agg(F.min("grade").alias("grade"))
