"""Best-fit packing of token sequences, bulk-synchronous.

Documents are cut into pieces of at most ``capacity`` tokens and the pieces placed into
as few sequences of ``capacity`` as best fit by falling length finds. A sequence with room
left is a gap; the gaps are a table, as the pieces are.

The supersteps go by falling length, in bands that end at a half, a third and a quarter of
the capacity and then at halves again. (No two pieces over a half share a sequence, so
each of those opens one.) In each superstep:

1. The band's pieces and the gaps are range-sorted together by falling size. Each range
   is swept by one task: gaps are pushed, and a piece takes the gap on top, the smallest
   that is pushed and not taken, its successor. A gap that holds several pieces of the
   band's greatest length is pushed as often, but no more than there are pieces for.
2. What a sweep leaves goes to the other ranges: the k-th piece left without a gap takes,
   by rank, the k-th from the top of what the ranges before it have left. Where two want
   the same gap the longer piece comes first, then the one read first. Only the numbers
   left by range are seen at one place; the rows meet in a join on range and rank.
3. Served gaps shrink. While pieces of the band are left and gaps that hold its longest,
   1 and 2 are repeated.
4. Pieces without any gap open sequences, which join the gaps: each range's are swept
   among themselves. The next band follows.

Edge cases: a null or empty text has its end token alone; equal lengths, copies and
repeated ids have one place each; an empty table gives no rows; columns other than the
id and the text aren't returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import read_ranks
from tessera.llm.common import stored

#: Rows of a range that one task sweeps, about.
RANGE_ROWS = 1 << 18
#: What the vocabulary's ``.json`` file has besides the ranks.
ADDED = {"<|endoftext|>": 50256}


@dataclass(frozen=True)
class Plan:
    """Rank ranges by length, then rank: the r-th piece of ``length[i]`` goes to sequence
    ``sequence[i] + r - rank[i]`` at ``offset[i]``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank: a successor search in the ranges."""
        wide = 1 << 40
        i = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        return self.sequence[i] + rank - self.rank[i], self.offset[i]


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """One task's sweep over the runs ``counts``, the number of pieces by length, with no gaps at first."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences: the first, how many
    has = np.zeros(capacity + 1, dtype=bool)
    ranges: list[tuple[int, int, int, int]] = []
    made = 0

    def leave(first: int, n: int, size: int) -> None:
        if n and size:
            gaps.setdefault(size, []).append((first, n))
            has[size] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        waiting, rank = int(counts[length]), 0
        while waiting:
            size = length + int(has[length:].argmax())
            if not has[size]:
                # no gap is left: new sequences, each with as many of these pieces as it holds
                each = capacity // length
                full, rest = divmod(waiting, each)
                for slot in range(min(each, waiting)):
                    ranges.append((length, rank, made, slot * length))
                    rank += full + (rest > slot)
                leave(made, full, capacity - each * length)
                leave(made + full, int(rest > 0), capacity - rest * length)
                made += full + (rest > 0)
                break
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                has[size] = False
            served = min(n, waiting)
            ranges.append((length, rank, first, capacity - size))
            leave(first, served, size - length)
            leave(first + served, n - served, size)
            rank, waiting = rank + served, waiting - served
    flat = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 4)
    return Plan(flat[:, 0], flat[:, 1], flat[:, 2], flat[:, 3], made)


def sweep(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each of one task's pieces, which come by falling length."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    above = np.cumsum(counts[::-1])[::-1] - counts
    return plan_packing(counts, capacity).place(lengths, np.arange(len(lengths)) - above[lengths])


def token_pieces(df: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], end_id: int, capacity: int, id_column: str, text: str) -> DataFrame:
    """The id, ``piece``, ``start``, ``length`` and ``ids_crc32``.

    ``encode()`` gives a task's encoder. What is over after whole pieces is the first piece."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encode()
        end = np.array([end_id], dtype="<u4")
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            rows: list[int] = []
            columns: tuple[list[int], ...] = ([], [], [], [])
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate((encoder(t or ""), end)).astype("<u4", copy=False)
                cuts = [*range(len(ids) % capacity or min(capacity, len(ids)), len(ids), capacity)]
                for piece, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ids)], strict=True)):
                    rows.append(k)
                    for column, value in zip(columns, (piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                [id_column, "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(kernel, f"{id_column} {kind}, piece int, start long, length long, ids_crc32 long")


def stack_match(push: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of (pops, the pushes that they take), of pops that find nothing, and of pushes that stay, in order.

    As with brackets: a pop takes the push that raised the stack to the height it finds."""
    height = np.cumsum(np.where(push, 1, -1))
    low = np.minimum.accumulate(np.minimum(height, 0))
    short = np.diff(low, prepend=0) < 0
    level = height - low + ~push
    some = np.flatnonzero(~short)
    some = some[np.argsort(level[some], kind="stable")]
    pairs = np.flatnonzero(push[some[:-1]] & ~push[some[1:]] & (level[some[:-1]] == level[some[1:]]))
    taken, pops = some[pairs], some[pairs + 1]
    stays = push.copy()
    stays[taken] = False
    return pops, taken, np.flatnonzero(short), np.flatnonzero(stays)


@dataclass(frozen=True)
class Carry:
    """Which pieces left by a range take which places left by ranges before it: runs of ranks."""

    part: np.ndarray
    rank: np.ndarray
    n: np.ndarray
    to_part: np.ndarray
    to_rank: np.ndarray
    taken: dict[int, int]

    def of_pieces(self, part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range and rank of the gap of each piece, -1 for none."""
        if not len(self.n):
            return np.full(len(part), -1), np.full(len(part), -1)
        i = np.maximum(np.searchsorted((self.part << 40) + self.rank, (part << 40) + rank, side="right") - 1, 0)
        good = (self.part[i] == part) & (rank >= self.rank[i]) & (rank < self.rank[i] + self.n[i])
        return np.where(good, self.to_part[i], -1), np.where(good, self.to_rank[i] + rank - self.rank[i], -1)

    def of_gaps(self, part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, which = np.unique(part, return_inverse=True)
        taken = np.array([self.taken.get(p, 0) for p in parts.tolist()], dtype=np.int64)
        good = rank < taken[which] if len(parts) else np.zeros(0, dtype=bool)
        return np.where(good, part, -1), np.where(good, rank, -1)


def carry_over(left: list[tuple[int, int, int]]) -> Carry:
    """From (range, pieces left, places left), in the order of the ranges."""
    stack: list[list[int]] = []
    runs: list[tuple[int, int, int, int, int]] = []
    taken: dict[int, int] = {}
    for part, pieces, places in left:
        rank = 0
        while rank < pieces and stack:
            top = stack[-1]
            n = min(pieces - rank, top[2])
            runs.append((part, rank, n, top[0], top[1]))
            taken[top[0]] = taken.get(top[0], 0) + n
            rank, top[1], top[2] = rank + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if places:
            stack.append([part, 0, places])
    flat = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return Carry(*flat.T, taken)


PAIR, PIECE, PLACE = 0, 1, 2


class Packing:
    """Gaps and placed pieces of ``rows``, a stored table of pieces with a number, ``__row``, for each."""

    def __init__(self, rows: DataFrame, capacity: int, id_column: str):
        self.rows, self.capacity = rows, capacity
        self.names = [id_column, "piece", "start", "length", "ids_crc32", "__row"]
        self.kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in self.names]
        self.out = [*self.names[:-1], "sequence_id", "offset"]
        # a sequence has the number of its first piece
        first = rows.where(F.col("length") > capacity // 2)
        self.placed = [first.select(*self.names[:-1], F.col("__row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
        self.gaps = first.where(F.col("length") < capacity).select(F.col("__row").alias("__seq"), (F.lit(capacity) - F.col("length")).alias("__gap"))

    def sweep_ranges(self, pieces: DataFrame, gaps: DataFrame, longest: int, often: int, parts: int) -> DataFrame:
        """Step 1: rows of ``__kind`` PAIR, PIECE (left without a gap) or PLACE (left in a gap)."""
        names = self.names
        piece_rows = pieces.select(F.lit(PIECE).alias("__kind"), F.col("length").alias("__gap"), F.col("__row").alias("__seq"), *names)
        gap_rows = gaps.select(F.lit(PAIR).alias("__kind"), "__gap", "__seq", *[F.lit(None).cast(self.rows.schema[n].dataType).alias(n) for n in names])
        order = [F.desc("__gap"), "__kind", "__seq"]
        ranged = piece_rows.unionByName(gap_rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            is_gap = table.column("__kind").to_numpy() == PAIR
            size, seq = table.column("__gap").to_numpy(), table.column("__seq").to_numpy()
            times = np.where(is_gap, np.clip(size // longest, 1, often), 1)
            at = np.repeat(np.arange(len(size)), times)
            # the first place of a gap is pushed last, so it is taken first
            slot = np.repeat(np.cumsum(times), times) - 1 - np.arange(len(at))
            pops, taken, short, stays = stack_match(is_gap[at])
            part = TaskContext.get().partitionId()

            def rows(kind: int, piece: np.ndarray | None, place: np.ndarray | None, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
                for i in range(0, len(rank), 1 << 16):
                    n = len(rank[i : i + (1 << 16)])
                    where = None if piece is None else pa.array(at[piece[i : i + n]])
                    own = [pa.nulls(n, table.schema.field(x).type) if where is None else table.column(x).take(where).combine_chunks() for x in names]
                    own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
                    spot = None if place is None else place[i : i + n]
                    gap = [pa.nulls(n, pa.int64())] * 3 if spot is None else [pa.array(seq[at[spot]]), pa.array(slot[spot]), pa.array(size[at[spot]])]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int64)), pa.array(rank[i : i + n].astype(np.int64)), *gap], [*names, "__kind", "__part", "__rank", "__seq", "__slot", "__gap"])

            yield from rows(PAIR, pops, taken, np.zeros(len(pops)))
            yield from rows(PIECE, short, None, np.arange(len(short)))
            yield from rows(PLACE, None, stays, np.arange(len(stays))[::-1])

        return ranged.mapInArrow(kernel, ", ".join([*self.kinds, "__kind int, __part long, __rank long, __seq long, __slot long, __gap long"]))

    def carried(self, swept: DataFrame, carry: Carry) -> DataFrame:
        """Step 2: what the sweeps left, with the range and rank, ``__tp`` and ``__tr``, at which a piece and a place meet."""
        columns = swept.columns

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                piece = batch.column(columns.index("__kind")).to_numpy() == PIECE
                part, rank = (batch.column(columns.index(c)).to_numpy() for c in ("__part", "__rank"))
                to = [np.full(len(part), -1), np.full(len(part), -1)]
                for some, of in ((piece, carry.of_pieces), (~piece, carry.of_gaps)):
                    for mine, got in zip(to, of(part[some], rank[some]), strict=True):
                        mine[some] = got
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(t, mask=t < 0) for t in to)], [*columns, "__tp", "__tr"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in swept.schema)
        return swept.where(F.col("__kind") != PAIR).mapInArrow(kernel, f"{schema}, __tp long, __tr long")

    def opened(self, left: DataFrame) -> DataFrame:
        """Step 4: sequences of the pieces of each range that no gap is left for."""
        capacity, names = self.capacity, self.names

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths, number = rows.column("length").to_numpy(), rows.column("__row").to_numpy()
            sequence, offset = sweep(lengths, capacity)
            first = np.flatnonzero(offset == 0)
            of = np.empty(len(first), dtype=np.int64)
            of[sequence[first]] = number[first]
            fill = np.bincount(sequence, weights=lengths).astype(np.int64)
            columns = [rows.column(n).combine_chunks() for n in names[:-1]]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(of[sequence]), pa.array(offset), pa.array(capacity - fill[sequence], mask=offset > 0)], [*names[:-1], "sequence_id", "offset", "__left"])

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                part = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a:
                        if held and held[0].column(0)[0].as_py() != part[a]:
                            yield packed(held)
                            held = []
                        held.append(batch.slice(a, b - a))
            if held:
                yield packed(held)

        dealt = left.select("__part", "__rank", *names).repartition("__part").sortWithinPartitions("__part", "__rank")
        return dealt.mapInArrow(kernel, ", ".join([*self.kinds[:-1], "sequence_id long, offset long, __left long"]))

    def served(self, swept: DataFrame, met: DataFrame) -> DataFrame:
        """The pieces that have a place, by the sweep or carried, with ``__left``: what their gap has left, once a gap."""
        pieces = met.where(F.col("__kind") == PIECE).select("__tp", "__tr", *self.names)
        places = met.where(F.col("__kind") == PLACE).select("__tp", "__tr", "__seq", "__slot", "__gap")
        pairs = swept.where(F.col("__kind") == PAIR).select(*self.names, "__seq", "__slot", "__gap")
        pairs = pairs.unionByName(pieces.join(places, ["__tp", "__tr"]).select(pairs.columns))
        # at most as many rows as fit one sequence
        inside = Window.partitionBy("__seq").orderBy("__slot")
        before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("length").over(Window.partitionBy("__seq"))
        offset = F.lit(self.capacity) - F.col("__gap") + before
        return pairs.select(*self.names[:-1], F.col("__seq").alias("sequence_id"), offset.alias("offset"), F.when(F.col("__slot") == 0, F.col("__gap") - total).alias("__left"))

    def add(self, placed: DataFrame) -> DataFrame:
        """Stores placed pieces and adds what their sequences have left to the gaps."""
        placed = stored(placed, "packed")
        self.placed.append(placed.select(self.out))
        self.gaps = self.gaps.unionByName(placed.where(F.col("__left") > 0).select(F.col("sequence_id").alias("__seq"), F.col("__left").alias("__gap")))
        return placed

    def superstep(self, shortest: int, longest: int, waiting: int) -> None:
        """All pieces of ``shortest`` to ``longest`` tokens, ``waiting`` in number."""
        pieces = self.rows.where(F.col("length").between(shortest, longest))
        while waiting:
            fits = self.gaps.where(F.col("__gap") >= shortest)
            n_gaps = fits.count()
            parts, often = -(-(waiting + n_gaps) // RANGE_ROWS), -(-waiting // max(n_gaps, 1))
            swept = stored(self.sweep_ranges(pieces, fits, longest, often, parts), "swept")
            left = swept.groupBy("__part").agg(F.count_if(F.col("__kind") == PIECE), F.count_if(F.col("__kind") == PLACE)).collect()
            carry = carry_over(sorted(map(tuple, left)))
            waiting = sum(r[1] for r in left) - int(carry.n.sum())
            rest, met = self.carried(swept, carry), F.col("__tp").isNotNull()
            pieces = rest.where((F.col("__kind") == PIECE) & ~met)
            # the first place of a gap is the first to be taken: where it is left, the gap is as it was
            same = rest.where((F.col("__kind") == PLACE) & (F.col("__slot") == 0) & ~met).select("__seq", "__gap")
            self.gaps = self.gaps.where(F.col("__gap") < shortest).unionByName(same)
            placed = self.add(self.served(swept, rest.where(met)))
            if waiting and placed.where(F.col("__left") >= longest).isEmpty():
                self.add(self.opened(pieces))
                break


def pack_pieces(pieces: DataFrame, capacity: int, id_column: str) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    rows = stored(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    count = dict(rows.groupBy("length").count().collect())
    state = Packing(rows, capacity, id_column)
    ends = [capacity // 2, capacity // 3]
    while ends[-1]:
        ends.append(capacity // 4 if len(ends) == 2 else ends[-1] // 2 if ends[-1] > 16 else 0)
    for longest, below in zip(ends[:-1], ends[1:], strict=True):
        waiting = sum(n for length, n in count.items() if below < length <= longest)
        if waiting:
            state.superstep(below + 1, longest, waiting)
    out = state.placed[0]
    for more in state.placed[1:]:
        out = out.unionByName(more)
    return out


@lru_cache(maxsize=1)
def rank_tool(path: str, pattern: str) -> tiktoken.Encoding:
    """One for each worker; the library keeps the ranks."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def rank_encoder(path: str, pattern: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """Encoders by a ``.tiktoken`` file's ranks; the strings of ``ADDED`` tokens have their ids, as in the ``.json`` file.

    The library's own splitting fails on runs of about a million white-space characters;
    a text that it refuses is split by ``regex`` and its pieces are merged one by one."""

    def encode(text: str) -> np.ndarray:
        for token, i in ADDED.items():
            if token in text:
                first, *rest = map(encode, text.split(token))
                return np.concatenate([first, *(x for part in rest for x in (np.array([i], dtype="<u4"), part))])
        tool = rank_tool(path, pattern)
        try:
            return tool.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return np.fromiter(chain.from_iterable(tool._encode_single_piece(m.group()) for m in regex.finditer(pattern, text)), dtype="<u4")

    return lambda: encode


def pack_documents(df: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = 1024, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all rows with their places: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    return pack_pieces(token_pieces(df, rank_encoder(path, pattern), end_id, capacity, id_column, text), capacity, id_column)
