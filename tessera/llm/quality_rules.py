"""Repetition rules on whole texts.

A text's bytes get one running polynomial hash; differences of it are the hashes of
words and lines, and those of the words, combined, are the hashes of n-grams of
several lengths. From these the characters inside duplicated n-grams and lines are
measured, with numpy over many texts at a time. Equal hashes only propose: words and
lines are compared by their bytes, n-grams by their words, and where a hash fits two
different ones, the keys are made anew from the content. So the counts are exact.

Words are runs of bytes other than space and 0x09-0x0D; characters are code points.
An n-gram or line counts as duplicated from its second place in the text on.

Edge cases: a null or empty text has no words, fails the base and isn't kept; a text
shorter than an n-gram has no such n-grams; a very long text is measured whole, as
its own group. Other columns of the input aren't returned; join by the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import keep_rows, row_ranges, text_bytes

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
GROUP_BYTES = 1 << 19
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """The base: at least ``min_words`` words, of which at most ``max_repeat`` percent lie
    in repeated 3-word windows. The method: the largest share of a text's word
    characters inside duplicated n-grams of each length, and inside duplicated lines."""

    min_words: int = 50
    max_repeat: int = 50
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.25, 7: 0.22, 10: 0.20})
    lines: float = 0.30


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the multiplier and of its inverse, grown as needed and bounded to a group's size."""

    def __init__(self) -> None:
        self.inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        self.grow(GROUP_BYTES)

    def grow(self, n: int) -> None:
        power = lambda base: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))))
        self.up, self.down = power(MULTIPLIER), power(self.inverse)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            self.grow(n)
        return self.up[:n], self.down


POWERS: list[Powers] = []


def running_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte values times powers, and the inverse powers."""
    if not POWERS:
        POWERS.append(Powers())
    up, down = POWERS[0].of(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up, out=total[1:])
    return total, down


def span_hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte span; equal bytes have equal hashes wherever they stand."""
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def neighbours(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, and (before, after) of each two that are next to each other there and equal."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    return order, order[:-1][same], order[1:][same]


def occurrences(keys: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], bool] | None = None, exact: Callable[[], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred before.

    ``equal`` says of pairs of equal keys whether all of them are equal in truth; if not, ``exact()`` gives true keys."""
    again, before = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        _, i, j = neighbours(keys)
        if equal is not None and len(i) and not equal(i, j):
            _, i, j = neighbours(exact())
        before[j] = True
        again[j] = True
        again[i] = True
    return again, before


def equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, long: int = 4096) -> bool:
    """Whether each span of ``length`` at ``a`` holds the same bytes as that at ``b``."""
    for i, j, n in zip(*(x[length > long].tolist() for x in (a, b, length)), strict=True):
        if not np.array_equal(raw[i : i + n], raw[j : j + n]):
            return False
    short = length <= long
    a, b, length = a[short], b[short], length[short]
    total = np.concatenate(([0], np.cumsum(length)))
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, total[at] + GROUP_BYTES, side="right")) - 1)
        n = length[at:end]
        step = np.arange(total[end] - total[at]) - np.repeat(total[at:end] - total[at], n)
        if (raw[np.repeat(a[at:end], n) + step] != raw[np.repeat(b[at:end], n) + step]).any():
            return False
        at = end
    return True


def number_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of spans by their bytes, through a table of all different ones."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(raw[a:b].tobytes(), len(numbers)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.int64)


def word_numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word; equal numbers exactly for equal bytes."""
    order, i, j = neighbours(hashes)
    length = end - start
    if not (np.array_equal(length[i], length[j]) and equal_bytes(raw, start[i], start[j], length[i])):
        return number_spans(raw, start, end)
    new = np.ones(len(hashes), dtype=np.int64)
    new[j] = 0
    out = np.empty(len(hashes), dtype=np.int64)
    out[order] = np.cumsum(new[order]) - 1
    return out


def covered(first: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in one of the n-word windows that start at ``first``."""
    change = np.zeros(words + 1, dtype=np.int32)
    change[:words] += first
    ends = np.flatnonzero(first) + n
    np.subtract.at(change, ends, 1)
    return np.cumsum(change[:words]) > 0


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive edges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[edges])


def measure(raw: np.ndarray, offsets: np.ndarray, ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text of one group."""
    n, size = len(offsets) - 1, len(raw)
    word_byte = ~BLANK[raw]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    previous = np.concatenate(([False], word_byte[:-1])) if size else word_byte
    following = np.concatenate((word_byte[1:], [False])) if size else word_byte
    start = np.flatnonzero(word_byte & (~previous | edge[:-1]))
    end = np.flatnonzero(word_byte & (~following | edge[1:])) + 1
    word_edges = np.searchsorted(start, offsets)
    point = word_byte & ((raw & 0xC0) != 0x80)
    points = np.concatenate(([0], np.cumsum(point, dtype=np.int64)))
    chars = points[end] - points[start]
    total, down = running_hash(raw)
    word = span_hash(total, down, start, end)
    text_of = np.repeat(np.arange(n), np.diff(word_edges))
    salt = mix(text_of.astype(np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(word_edges), "word_chars": np.diff(points[offsets]), "n_symbols": sums(SYMBOL[raw], offsets)}

    # lines: between line feeds and text edges
    feeds = np.flatnonzero(raw == 0x0A)
    line_start = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    line_end = np.sort(np.concatenate((offsets[1:], feeds)))
    line_text = np.searchsorted(offsets, line_start, side="right") - 1
    # a line feed at a text's end starts an empty line there, which belongs to that text and has no word
    with_word = points[line_end] > points[line_start]
    ls, le, lt = line_start[with_word], line_end[with_word], line_text[with_word]
    _, earlier = occurrences(
        span_hash(total, down, ls, le) ^ mix(lt.astype(np.uint64) + np.uint64(1)),
        lambda i, j: np.array_equal(lt[i], lt[j]) and np.array_equal((le - ls)[i], (le - ls)[j]) and equal_bytes(raw, ls[i], ls[j], (le - ls)[i]),
        lambda: number_spans(raw, ls, le) * n + lt,
    )
    out["n_dup_lines"] = np.bincount(lt[earlier], minlength=n)[:n]
    out["dup_line_chars"] = np.bincount(lt[earlier], weights=(points[le] - points[ls])[earlier], minlength=n)[:n].astype(np.int64)

    numbers = word_numbers(raw, start, end, word)
    word = mix(numbers.astype(np.uint64) + np.uint64(1))
    gram, length = word, 1
    for want in sorted({3, *ngrams}):
        while length < want:
            longer = np.zeros_like(word)
            if len(word) > length:
                longer[:-length] = mix(gram[:-length] * np.uint64(0xC2B2AE3D27D4EB4F) + word[length:])
            gram, length = longer, length + 1
        inside = np.zeros(len(word), dtype=bool)
        if len(word) >= want:
            inside[: len(word) - want + 1] = text_of[want - 1 :] == text_of[: len(word) - want + 1]
        place = np.flatnonzero(inside)
        again, earlier = occurrences((gram ^ salt)[place], partial(equal_grams, numbers, text_of, place, want), partial(number_grams, numbers, text_of, place, want))
        if want == 3:
            first = np.zeros(len(word), dtype=bool)
            first[place[again]] = True
            out["n_repeat_words"] = sums(covered(first, 3, len(word)), word_edges)
        if want in ngrams:
            first = np.zeros(len(word), dtype=bool)
            first[place[earlier]] = True
            out[f"dup_{want}gram_chars"] = sums(covered(first, want, len(word)) * chars, word_edges)
    return out


def equal_grams(numbers: np.ndarray, text_of: np.ndarray, place: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether each two n-grams stand in one text and have the same words."""
    a, b = place[i], place[j]
    return np.array_equal(text_of[a], text_of[b]) and all(np.array_equal(numbers[a + k], numbers[b + k]) for k in range(n))


def number_grams(numbers: np.ndarray, text_of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n-grams by their words and text."""
    rows = np.column_stack((text_of[place], *(numbers[place + k] for k in range(n))))
    return np.unique(rows, axis=0, return_inverse=True)[1].ravel()


def judge(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """``base_failed`` and ``kept`` for each text."""
    failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat * m["n_words"])
    all_chars = np.maximum(m["word_chars"], 1)
    bad = m["dup_line_chars"] > limits.lines * all_chars
    for n, share in limits.ngrams.items():
        bad |= m[f"dup_{n}gram_chars"] > share * all_chars
    return failed, ~failed & ~bad


def repetition_rules(df: DataFrame, id_column: str = "doc_id", text: str = "text", limits: Limits | None = None) -> DataFrame:
    """The id, the base's counts, ``base_failed``, ``kept``, and the characters in duplicated lines and n-grams."""
    limits = limits or Limits()
    ngrams = tuple(sorted(limits.ngrams))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in ngrams)]
    names = [id_column, *counts, "base_failed", "kept"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in row_ranges(offsets, GROUP_BYTES):
                m = measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ngrams)
                failed, kept = judge(m, limits)
                columns = [batch.column(0).slice(a, b - a), *(pa.array(m[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return df.select(id_column, text).mapInArrow(kernel, schema)


def keep_texts(df: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows that :func:`repetition_rules` keeps, with all their columns."""
    limits = limits or Limits()
    ngrams = tuple(sorted(limits.ngrams))
    return keep_rows(df, text, lambda: lambda raw, offsets: judge(measure(raw, offsets, ngrams), limits)[1], GROUP_BYTES)
