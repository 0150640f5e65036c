"""Byte-level BPE: encoding by ranks with a segment tree, and decoding.

A piece starts as one node for each byte. A segment tree over the byte positions
holds at every position the rank of the pair that starts there (infinite where there
is none) and above it the leftmost minimum. A merge takes the root, joins the node
with its live right neighbour, and updates three leaves and their ancestors: the
merged position, its left neighbour, and the position that died.

Pieces of a batch are encoded together: the trees of all pieces of one padded length
are rows of one array, and each step merges once in every row that still has a pair.
Long pieces have a tree of their own. Distinct pieces are encoded once for each
batch, and those of frequent texts are kept in a bounded cache.

Edge cases: a null text is empty and has no ids; a piece that is a token itself is
that token; any bytes encode, since single bytes are tokens; texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int64(1) << 40
#: Pieces of more bytes have a tree of their own.
WIDE = 64


class Ranks:
    """A vocabulary: bytes of each id, and a table from a pair of ids to the merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = pairs
        self.build_table()
        self.piece_of = {str(i): token for i, token in enumerate(self.bytes_of)}

    def build_table(self) -> None:
        """Open addressing over numpy arrays: a look-up takes a few probes for whole arrays at once."""
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        size = 1 << self.bits
        self.table_key = np.full(size, -1, dtype=np.int64)
        self.table_rank = np.full(size, NONE, dtype=np.int64)
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        ranks = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        slot = self.slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.table_key[slot] == -1
            self.table_key[slot[free]] = keys[free]
            self.table_rank[slot[free]] = ranks[free]
            left = self.table_key[slot] != keys
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none."""
        keys = left << 20 | right
        at = self.slot(keys)
        out = np.full(len(keys), NONE, dtype=np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.table_key[at]
            hit = found == keys
            out[open_[hit]] = self.table_rank[at[hit]]
            more = ~hit & (found != -1)
            if not more.any():
                break
            open_, keys, at = open_[more], keys[more], (at[more] + 1) & (len(self.table_key) - 1)
        return out


def encode_many(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of every piece."""
    out: list[list[int] | None] = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = ranks.ranks.get(piece)
        if whole is not None:
            out[k] = [whole]
        elif not piece:
            out[k] = []
        elif len(piece) > WIDE:
            out[k] = encode_long(piece, ranks)
        else:
            groups.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
    for width, rows in groups.items():
        for i in range(0, len(rows), 1 << 15):
            some = rows[i : i + (1 << 15)]
            for k, ids in zip(some, encode_rows([pieces[k] for k in some], width, ranks), strict=True):
                out[k] = ids
    return out


def encode_rows(pieces: list[bytes], width: int, ranks: Ranks) -> list[list[int]]:
    """Pieces of 2 to ``width`` bytes, ``width`` a power of two; a row of the arrays for each."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    ids = ranks.byte_ids[raw]
    column = np.arange(width)
    ids[column >= lengths[:, None]] = -1
    after = np.minimum(column + 1, lengths[:, None])
    before = np.broadcast_to(column - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, dtype=np.int64)
    live = column[None, :] + 1 < lengths[:, None]
    r, c = np.nonzero(live)
    # a leaf holds rank * width + position, so that the least is also the leftmost
    tree[r, width + c] = with_place(ranks.rank(ids[r, c], ids[r, c + 1]), c, width)
    half = width // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        at, merged = root % width, root // width
        dead = after[rows, at]
        right = after[rows, dead]
        ids[rows, at] = merged
        ids[rows, dead] = -1
        after[rows, at] = right
        has_right = right < lengths[rows]
        before[rows[has_right], right[has_right]] = at[has_right]
        left = before[rows, at]
        has_left = left >= 0
        set_leaf(tree, rows, dead, np.full(len(rows), NONE), width)
        set_leaf(tree, rows, at, pair_value(rows, at, right, has_right, ids, ranks, width), width)
        lr, lc = rows[has_left], left[has_left]
        set_leaf(tree, lr, lc, pair_value(lr, lc, at[has_left], np.ones(len(lr), bool), ids, ranks, width), width)
        rows = rows[tree[rows, 1] < NONE]
    kept = ids >= 0
    flat, counts = ids[kept].tolist(), kept.sum(axis=1).tolist()
    out, start = [], 0
    for c in counts:
        out.append(flat[start : start + c])
        start += c
    return out


def with_place(rank: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    return np.where(rank >= NONE, NONE, rank * width + place)


def pair_value(rows: np.ndarray, at: np.ndarray, right: np.ndarray, has: np.ndarray, ids: np.ndarray, ranks: Ranks, width: int) -> np.ndarray:
    out = np.full(len(rows), NONE, dtype=np.int64)
    r, a = rows[has], at[has]
    out[has] = with_place(ranks.rank(ids[r, a], ids[r, right[has]]), a, width)
    return out


def set_leaf(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Point update of one leaf in each row and of its ancestors."""
    node = width + at
    tree[rows, node] = value
    node = node >> 1
    while node.size and node[0]:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node = node >> 1


def encode_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece of any length by a tree of its own."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    ids = [ranks.ranks[piece[i : i + 1]] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, pairs = int(NONE), ranks.pairs
    tree = [none << 30] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = pairs.get(ids[i] << 20 | ids[i + 1], none) << 30 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(at: int, rank: int) -> None:
        k = width + at
        tree[k] = rank << 30 | at
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
            k >>= 1

    while (top := tree[1]) >> 30 < none:
        at, merged = top & ((1 << 30) - 1), top >> 30
        dead = after[at]
        right = after[dead]
        ids[at], ids[dead] = merged, -1
        after[at] = right
        if right < n:
            before[right] = at
        put(dead, none)
        put(at, pairs.get(merged << 20 | ids[right], none) if right < n else none)
        if (left := before[at]) >= 0:
            put(left, pairs.get(ids[left] << 20 | merged, none))
    return [i for i in ids if i >= 0]


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """From lines of a ``.tiktoken`` file: base64 of the token, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return load_ranks(f)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Ranks:
    return Ranks(read_ranks(path))


class Encoder:
    """Texts to ids, with the pieces' ids cached as decimal text.

    The cache empties when it is full, and a piece of more than ``LONGEST`` characters stays
    for its own texts only, so the cache has a bound in bytes."""

    LONGEST = 64

    def __init__(self, ranks: Ranks, pattern: str, cache_pieces: int = 600_000):
        self.ranks, self.split, self.cache_pieces = ranks, regex.compile(pattern).findall, cache_pieces
        self.cache: dict[str, str] = {}

    def learn(self, missing: set[str]) -> None:
        if len(self.cache) + len(missing) > self.cache_pieces:
            self.cache.clear()
        some = list(missing)
        for piece, ids in zip(some, encode_many([p.encode() for p in some], self.ranks), strict=True):
            self.cache[piece] = " ".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by one space."""
        split = [self.split(t) for t in texts]
        missing: set[str] = set()
        for pieces in split:
            missing.update(pieces)
        fresh = missing.difference(self.cache)
        if fresh:
            if len(self.cache) + len(fresh) > self.cache_pieces:
                self.cache.clear()
                fresh = missing
            self.learn(fresh)
        get = self.cache.__getitem__
        out = [" ".join(map(get, pieces)) for pieces in split]
        for piece in fresh:
            if len(piece) > self.LONGEST:
                del self.cache[piece]
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.ranks.piece_of.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(vocabulary(path), pattern)


def text_groups(values: list[str | None], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters."""
    group, held = [], 0
    for v in values:
        group.append(v or "")
        held += len(group[-1])
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode_texts(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False, group_chars: int = 4 << 20) -> DataFrame:
    """The id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space),
    ``decoded_sha256`` (of the bytes that the ids decode to) and, if asked for, ``ids``."""
    id_type = df.schema[id_column].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1).to_pylist(), group_chars):
                encoded = tool.encode(group)
                columns = [
                    batch.column(0).slice(at, len(group)),
                    pa.array([x.count(" ") + 1 if x else 0 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(tool.decode(x)).hexdigest() for x in encoded], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([[int(i) for i in x.split()] for x in encoded], pa.list_(pa.int32())))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = f"{id_column} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return df.select(id_column, text).mapInArrow(kernel, schema)
