"""SimHash near-duplicates through an inverted index of byte positions.

A text's fingerprint takes each bit from the majority of its word shingles' hashes. It
has one or more 64-bit words; those after the first mix the shingles' hashes anew.

Two 8-byte fingerprints within ``max_bits`` differ in at most that many bytes, so they
share at least ``8 - max_bits`` positional bytes: the guaranteed minimum. A posting list
of a single positional byte would hold a 256th of all rows, so the index is on
combinations of positions, chosen so that any two fingerprints that share the minimum
share a whole combination (a Turan covering: 20 triples for four shared bytes).

Within a posting list the shared positional bytes of each pair are tallied, pairs below
the minimum dropped, and the rest verified by their bits; what leaves a list is a
spanning star of its verified links, never all pairs. A list longer than ``block`` is
split into pairs of blocks, each a list of its own. Equal fingerprints are one node from
the start, so copies are never paired.

Longer fingerprints are for a similarity (Jaccard, of the sets of shingles) at which no
byte is sure to be shared. Each distinct shingle votes once, and the index only proposes:

* at 0.8 about 15 % of the bits differ. The 80 bytes of ten words fall into groups of
  five, indexed by all pairs in a group: 160 keys, of which two texts share one with
  probability 0.9998 if their bits differ independently;
* a posting carries the first ``CARRIED`` words, of which ``max_bits`` may differ: 40 of
  128 where 19 are expected, with a deviation of 4;
* what passes in the lists that a task has at a time is chained to the least id of its
  chain. All that has one such root is a group; two texts that are proposed to each other
  are together in one;
* a group's texts meet in one task, a long group's in pairs of blocks, and are compared by
  their sets of shingles unless links found there join them already. What leaves a group
  is a spanning forest of its links, never its pairs.

Edge cases: a null text and one without words have fingerprint zero and link like any
other, two of them being equal; a text of fewer words than a shingle is one shingle; a row with a null id gets
its fingerprint and the least known id of its group; repeated ids keep all their rows;
an empty table gives an empty result. Ids are whole numbers; another type of id raises an
error. Other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import broadcast_if_small, cut
from tessera.llm.components import connected_components, own_key, spanning_edges
from tessera.llm.quality_rules import mix

SEED = 42
POSITIONS = 8
#: Words of a long fingerprint that its postings carry, and the bytes of a group whose pairs index it.
CARRIED, GROUP = 2, 5


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """The hash of each shingle, with repeats; none without tokens."""
    n = len(tokens) - words + 1
    shingles = [b" ".join(tokens)][: len(tokens)] if n < 1 else map(b" ".join, zip(*(tokens[i : n + i] for i in range(words)), strict=True))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(s, seed) for s in shingles], dtype=np.uint64)


def fingerprint(text: str | None, words: int, size: int = 1, once: bool = False) -> np.ndarray:
    """``size`` 64-bit words of one text's fingerprint. A shingle votes as often as it stands, or ``once``."""
    out = np.zeros(size, dtype=np.uint64)
    hashes = shingle_hashes((text or "").encode().lower().split(), words)
    if not len(hashes):
        return out
    if once:
        hashes = np.unique(hashes)
    for w in range(size):
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), 1 << 13):
            part = hashes[i : i + (1 << 13)]
            part = mix(part + np.uint64(w)) if w else part
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        out[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, size: int = 1, once: bool = False) -> DataFrame:
    """The id and ``fp``: the fingerprint's bytes, each word's highest first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fps = [fingerprint(t, words, size, once).astype(">u8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary())], [id_column, "fp"])

    return df.select(id_column, text).mapInArrow(kernel, f"{id_column} {df.schema[id_column].dataType.simpleString()}, fp binary")


def position_sets(minimum: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``minimum`` positions hold one of them whole.

    Positions fall into groups. For pairs, ``minimum - 1`` groups: of ``minimum``
    positions two are in one group. For triples out of four, three groups in a ring:
    triples inside a group, or two in one and the third in the next.
    """
    if size == 2:
        groups = [range(g, POSITIONS, minimum - 1) for g in range(minimum - 1)]
        return [p for g in groups for p in combinations(g, 2)]
    if (minimum, size) == (4, 3):
        group = lambda p: p % 3
        fits = lambda s: len(set(s)) == 1 or any(s.count(g) == 2 and s.count((g + 1) % 3) == 1 for g in range(3))
        return [p for p in combinations(range(POSITIONS), 3) if fits([group(x) for x in p])]
    return list(combinations(range(POSITIONS), size))


def index_keys(fps: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """The posting keys of each fingerprint, (n, sets): the set's number and its bytes."""
    data = fps.view(np.uint8).reshape(len(fps), -1).astype(np.int64)
    out = np.empty((len(fps), len(sets)), dtype=np.int64)
    for k, positions in enumerate(sets):
        key = np.full(len(fps), k, dtype=np.int64)
        for p in positions:
            key = key << 8 | data[:, p]
        out[:, k] = key
    return out


def linked(x: np.ndarray, y: np.ndarray, minimum: int, max_bits: int) -> np.ndarray:
    """Which rows of ``x`` and ``y``, (n, words), pass: the tally of equal bytes, then the differing bits."""
    differ = x ^ y
    out = (differ.view(np.uint8) == 0).sum(axis=1) >= minimum
    out[out] = np.bitwise_count(differ[out]).sum(axis=1) <= max_bits
    return out


def list_links(fps: np.ndarray, ids: np.ndarray, minimum: int, max_bits: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of the links of one posting list, ``cells`` pairs at a time."""
    n = len(fps)
    stars: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
    step = max(1, cells // n)
    for i in range(0, n, step):
        a, b = np.triu_indices(min(step, n - i), 1, n - i)
        good = linked(fps[i + a], fps[i + b], minimum, max_bits)
        if good.any():
            stars = spanning_edges(np.concatenate((stars[0], ids[i + a[good]])), np.concatenate((stars[1], ids[i + b[good]])))
    return stars


def partition_links(key: np.ndarray, fps: np.ndarray, ids: np.ndarray, minimum: int, max_bits: int, short: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of all posting lists in sorted arrays: short lists together by distance in the list, long ones one by one."""
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cuts)
    out = []
    in_short = np.repeat(sizes <= short, sizes)
    for d in range(1, min(short, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[d:] == key[:-d]) & in_short[:-d])
        if len(i):
            good = linked(fps[i], fps[i + d], minimum, max_bits)
            out.append((ids[i[good]], ids[i[good] + d]))
    for k in np.flatnonzero(sizes > short):
        a, b = cuts[k], cuts[k + 1]
        out.append(list_links(fps[a:b], ids[a:b], minimum, max_bits))
    return out


def similar_links(nodes: DataFrame, size: int, max_bits: int, minimum: int, sets: list[tuple[int, ...]], block: int = 2048, carried: int | None = None) -> DataFrame:
    """Links (u, v) between ``nodes`` (``fp`` distinct, ``node``) that span the components of
    all pairs which share a key of ``sets``, ``minimum`` bytes, and differ in ``max_bits`` at most.

    Bytes and bits are those of the first ``carried`` words, if given. Each link is from a
    node to the least of those that pairs chain to it in the lists that a task has at a time."""
    carried = carried or size

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                fps = packed(part.column(0), size)
                keys = index_keys(fps, sets)
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(sets)))
                short = pa.array([x.tobytes() for x in fps[:, :carried]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), short.take(rows), part.column(1).take(rows)], ["key", "fp", "node"])

    postings = nodes.select("fp", "node").mapInArrow(post, "key long, fp binary, node long")
    long_lists = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(F.col("key").alias("long_key"), F.ceil(F.col("n") / block).alias("blocks")))
    joined = postings.join(broadcast_if_small(long_lists), F.col("key") == F.col("long_key"), "left")
    own = F.coalesce(F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks")), F.lit(0))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = joined.withColumn("own", own).withColumn("other", other)
    # a list's number: the key, and in long lists the pair of blocks
    number = F.shiftleft("key", 34) + F.shiftleft(F.least("own", "other"), 17) + F.greatest("own", "other")
    dealt = spread.select(number.alias("list"), "fp", "node").repartition("list").sortWithinPartitions("list")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            links = partition_links(*columns, minimum, max_bits)
            u = np.concatenate([a for a, _ in links]) if links else np.empty(0, np.int64)
            v = np.concatenate([b for _, b in links]) if links else np.empty(0, np.int64)
            if len(u):
                u, v = spanning_edges(u, v)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [batch.column(0).to_numpy(), packed(batch.column(1), carried), batch.column(2).to_numpy()]
            if rest is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            # a list that may go on in the next batch waits for it
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last:
                yield found([c[:last] for c in columns])
            rest = [c[last:] for c in columns]
        if rest is not None and len(rest[0]):
            yield found(rest)

    return dealt.mapInArrow(link, "u long, v long")


def packed(column: pa.Array, size: int) -> np.ndarray:
    """Fingerprints of a binary column as (n, size) 64-bit words."""
    raw, offsets = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(column.buffers()[1], dtype=np.int32)
    first = int(offsets[column.offset])
    return np.ascontiguousarray(raw[first : first + len(column) * size * 8]).view(np.uint64).reshape(-1, size)


def group_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the components of all pairs of ``sets`` (sorted, without repeats) of ``similarity`` at least.

    Each set meets, at once, all later ones that links found so far don't join to it. Two empty ones are equal."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(len(values), dtype=np.int64)
    label = np.arange(n)
    out = []
    for i in range(n - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(j):
            if (label == label[0]).all():
                break
            continue
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])]
        if not len(j):
            continue
        own = numbers[cuts[i] : cuts[i + 1]]
        marked[own] = 1
        at = np.repeat(cuts[j] - np.concatenate(([0], np.cumsum(size[j])[:-1])), size[j]) + np.arange(size[j].sum())
        total = np.concatenate(([0], np.cumsum(marked[numbers[at]])))
        common = np.diff(total[np.concatenate(([0], np.cumsum(size[j])))])
        marked[own] = 0
        near = j[common >= similarity * (size[i] + size[j] - common)]
        for k in near.tolist():
            if label[k] != label[i]:
                out.append((i, k))
                label[label == label[k]] = label[i]
    return out


def verified_links(df: DataFrame, proposed: DataFrame, id_column: str, text: str, words: int, similarity: float, block: int) -> DataFrame:
    """Links (u, v) that span the components of all pairs of a group whose texts' sets of shingles
    have ``similarity`` at least. ``proposed``, materialised: (u, v), a node and the root of its group.

    Where an id has several texts, one pair of them is enough."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstd.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data = [tool.compress(b" ".join((t or "").encode().lower().split())) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["n", "words"])

    roots = proposed.select(F.col("v").alias("root"), F.col("v").alias("node")).distinct()
    members = cut(proposed.select(F.col("v").alias("root"), F.col("u").alias("node")).unionByName(roots))
    own = df.select(F.col(id_column).cast("long").alias("n"), F.col(text).alias("t"))
    ends = cut(members.select(F.col("node").alias("end")).distinct())
    chosen = own.join(broadcast_if_small(ends), F.col("n") == F.col("end"), "left_semi")
    texts = chosen.mapInArrow(words_of, "n long, words binary").distinct()
    long_groups = cut(members.groupBy(F.col("root").alias("long_root")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("long_root", F.ceil(F.col("size") / block).alias("blocks")))
    spread = members.join(broadcast_if_small(long_groups), F.col("root") == F.col("long_root"), "left")
    spread = spread.withColumn("own", F.coalesce(F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")), F.lit(0)))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    spread = spread.select("root", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), own_key("node").alias("node"))
    lists = ["root", "b0", "b1"]
    met = spread.join(texts, F.col("node") == F.col("n")).select(*lists, "node", "words")
    dealt = met.repartition(*lists).sortWithinPartitions(*lists, "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstd.ZstdDecompressor()
        held: list[tuple[int, np.ndarray]] = []
        now = None

        def found() -> pa.RecordBatch:
            links = group_links([x for _, x in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array([held[b][0] for _, b in links], pa.int64()), pa.array([held[a][0] for a, _ in links], pa.int64())], ["u", "v"])

        for batch in batches:
            for root, b0, b1, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, b0, b1) != now:
                    if len(held) > 1:
                        yield found()
                    held, now = [], (root, b0, b1)
                held.append((node, np.unique(shingle_hashes(tool.decompress(data).split(), words))))
        if len(held) > 1:
            yield found()

    return dealt.mapInArrow(check, "u long, v long")


def similar_components(df: DataFrame, nodes: DataFrame, id_column: str, text: str, words: int, size: int, max_bits: int, minimum: int, similarity: float, block: int) -> DataFrame:
    """(node, component) of the links of ``similarity`` among the pairs that the index proposes."""
    sets = [p for g in range(0, POSITIONS * size, GROUP) for p in combinations(range(g, min(g + GROUP, POSITIONS * size)), 2)]
    proposed = cut(similar_links(nodes, size, max_bits, minimum, sets, block, min(CARRIED, size)).distinct())
    links = verified_links(df, proposed, id_column, text, words, similarity, block // 2)
    return connected_components(links, "u", "v", contracted=True)


def simhash_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, size: int = 10, max_bits: int = 40, minimum: int | None = None, similarity: float = 0.8, block: int = 2048) -> DataFrame:
    """The id, ``fingerprint`` (hex) and ``component_id``, the least id reachable over links.

    The defaults link texts whose sets of five-word shingles have a similarity of 0.8 at least.
    With ``size`` 1 all pairs within ``max_bits`` (6 at most) link, and ``similarity`` isn't used."""
    if not isinstance(df.schema[id_column].dataType, T.IntegralType):
        raise TypeError(f"{id_column} has to be a whole number")
    rows = cut(fingerprints(df, id_column, text, words, size, once=size > 1))
    # a fingerprint of rows without an id has no node to link by
    nodes = rows.groupBy("fp").agg(F.min(id_column).cast("long").alias("node"))
    known = nodes.where("node is not null")
    if size == 1:
        minimum = POSITIONS - max_bits
        if minimum < 2:
            raise ValueError("at most 6 bits: fewer than two positional bytes are guaranteed beyond that")
        links = similar_links(known, size, max_bits, minimum, position_sets(minimum, 3 if minimum >= 4 else 2), block)
        component = connected_components(links, "u", "v", contracted=True)
    else:
        component = similar_components(df, known, id_column, text, words, size, max_bits, minimum or 0, similarity, block)
    component = component.select(F.col("node").alias("n"), "component")
    group = nodes.join(component, F.col("node") == F.col("n"), "left").select(F.col("fp").alias("group_fp"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(group, F.col("fp") == F.col("group_fp"), "left")
    return out.select(id_column, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows whose id is the least of its group, with all their columns; rows without an id stay, and
    rows that repeat an id share its decision."""
    copies = simhash_groups(df, id_column, text, **options).where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__copy"))
    return df.join(broadcast_if_small(cut(copies.distinct())), F.col(id_column) == F.col("__copy"), "left_anti")
