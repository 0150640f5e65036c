"""Brown class-based bigram language model.

The ``core_words`` most frequent words are clustered by the exchange algorithm on the
bigram counts of the whole training corpus. Then every other word that occurs
``least_count`` times or more, up to the table's ``frequent_words`` words, makes its
exchange move: from its counts before and after each class, over the whole corpus, to the
class where the likelihood is highest. All rarer words form one class of their own, and
so does a text's end. A token's probability is that of its class after the class before
it, times that of the word in its class:

* class transitions: counts of all words' classes with ``alpha`` pseudo-counts spread by class frequency;
* words of the clusters: their share of their class;
* rare words: absolute discounting by ``discount``, what it frees being spread evenly
  over the class's words and one unknown word.

Counts are distributed and cover every training text. Five passes read the texts: word
counts, bigrams of the core, neighbours of the other words, class bigrams, scoring. Scoring looks ``frequent_words``
words up in a broadcast table (its length is the bound); only the rest of a text's
words, counted by text, are shuffled to be joined with their counts, so no frequent
word is ever a hot key.

Tokens are bytes: A-Z lower-cased, split at space and 0x09-0x0D, then one end. Edge
cases: a null or empty text is one end token; without training texts every count is
zero; repeated ids are scored row by row; other columns aren't returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: The end of a text in the table of counts; no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, without the end."""
    return (text or "").encode().lower().split()


@dataclass
class Model:
    """``counts``: (word, c) of all training tokens. ``words``: the frequent ones, the end first,
    then by falling count; the first ``clustered`` of them have classes of their own."""

    counts: DataFrame
    total: int
    distinct: int
    words: list[bytes]
    word_counts: np.ndarray
    clustered: int
    word_class: np.ndarray
    transition: np.ndarray
    class_counts: np.ndarray
    rest_total: int
    rest_distinct: int
    discount: float

    def rest_log10(self, c: np.ndarray) -> np.ndarray:
        """log10 probability of words of the last class by their counts."""
        free = self.discount * self.rest_distinct / max(self.rest_total, 1) if self.rest_total else 1.0
        return np.log10(np.maximum(c - self.discount, 0) / max(self.rest_total, 1) + free / (self.rest_distinct + 1))

    def rest_column(self, c: Column) -> Column:
        free = self.discount * self.rest_distinct / max(self.rest_total, 1) if self.rest_total else 1.0
        return F.log10(F.greatest(c - self.discount, F.lit(0.0)) / float(max(self.rest_total, 1)) + free / (self.rest_distinct + 1))

    def base_log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))

    def base_column(self, c: Column) -> Column:
        return F.log10((c + 1) / F.lit(float(self.total + self.distinct + 1)))


def word_counts(texts: DataFrame, text: str, most: int = 400_000) -> DataFrame:
    """(word, c) over all rows; each task counts before the exchange and empties its table at ``most`` words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
                seen[END] += 1
                if len(seen) > most:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return texts.select(text).mapInArrow(kernel, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """About ``most`` words by falling count, and their counts.

    A histogram of the counts' logarithms, in sixteenths, tells from which count on the
    words are few enough; of the level that has too many, a share is taken by the words'
    hash. Those words are fetched, and no task has to sort more."""
    level = F.floor(F.log2("c") * 16)
    words = counts.where(F.length("word") > 0)
    total, chosen = 0, F.lit(False)
    for at, n in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if total + n > most:
            below = int((most - total) / n * (1 << 30))
            chosen = chosen | ((level == at) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < below))
            break
        total, chosen = total + n, level >= at
    rows = words.where(chosen).toArrow()
    pairs = sorted(zip(rows["c"].to_pylist(), rows["word"].to_pylist(), strict=True), key=lambda p: (-p[0], p[1]))
    return [w for _, w in pairs], np.array([c for c, _ in pairs], dtype=np.int64)


def token_runs(batches: Iterator[pa.RecordBatch], get: Callable[[bytes, int], int], other: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The words' numbers, texts end to end with number 0, their end, before and after each; about ``most`` at a time."""
    for batch in batches:
        held: list[int] = [0]
        for t in batch.column(0).to_pylist():
            held.extend([get(w, other) for w in tokens(t)])
            held.append(0)
            if len(held) > most:
                yield np.array(held, dtype=np.int64)
                held = [0]
        if len(held) > 1:
            yield np.array(held, dtype=np.int64)


def class_bigrams(texts: DataFrame, text: str, words: list[bytes], word_class: np.ndarray, n: int) -> np.ndarray:
    """Bigram counts between the ``n`` classes of ``words`` (the end first, also as what comes before
    a text) and, with the last class of ``word_class``, all others.

    The matrix has ``n ** 2`` cells whatever the corpus; each task adds its own up first."""
    shared = texts.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, word_class))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cls = shared.value
        cells = np.zeros(n * n, dtype=np.int64)
        for ids in token_runs(batches, table.get, len(table)):
            ids = cls[ids]
            cells += np.bincount(ids[:-1] * n + ids[1:], minlength=n * n)
        some = np.flatnonzero(cells)
        for i in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + (1 << 16)]), pa.array(cells[some[i : i + (1 << 16)]])], ["cell", "c"])

    rows = texts.select(text).mapInArrow(kernel, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n * n, dtype=np.int64)
    out[rows["cell"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(n, n)


def assign_classes(texts: DataFrame, text: str, words: list[bytes], core: int, core_class: np.ndarray, grid: np.ndarray, classes: int, most: int = 1 << 23) -> np.ndarray:
    """The class, of the first ``classes``, of each of ``words`` from ``core`` on.

    ``core_class``: that of the core's words, then that of all others, in which they are
    counted as neighbours. ``grid``: the core's class bigrams. Each task adds up the
    neighbours' classes of its words, and they meet by word; what reaches the driver is
    one class for each word of the table. A task adds up ``most`` neighbours at a time."""
    k = len(grid)
    shared = texts.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, np.concatenate((core_class[:core], np.full(len(words) - core + 1, core_class[core])))))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cls = shared.value
        # sorting narrow numbers is several times as fast
        kind = np.int32 if 2 * k * len(table) < 1 << 31 else np.int64
        held: list[np.ndarray] = []
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            cells, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(cells), 1 << 16):
                some = cells[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((some // (2 * k)).astype(np.int32)), pa.array((some % (2 * k)).astype(np.int32)), pa.array(c[i : i + (1 << 16)].astype(np.int64))], ["w", "cell", "c"])

        for ids in token_runs(batches, table.get, len(table)):
            at = np.flatnonzero((ids >= core) & (ids < len(table)))
            first = ids[at] * (2 * k)
            held += [(first + cls[ids[at - 1]]).astype(kind), (first + k + cls[ids[at + 1]]).astype(kind)]
            n += 2 * len(at)
            if n > most:
                yield from rows()
                held, n = [], 0
        if n:
            yield from rows()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.astype(np.float64)
        out, into = g.sum(axis=1), g.sum(axis=0)
        rows, columns = g[:classes], g[:, :classes].T
        for part in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            lists = part.column(1)
            counts = np.zeros((part.num_rows, 2 * k))
            counts[np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = part.column(2).flatten().to_numpy()
            before, after = counts[:, :k], counts[:, k:]
            gain = np.zeros((part.num_rows, classes))
            for c in range(classes):
                gain[:, c] = (xlogx(rows[c] + after) - xlogx(rows[c])).sum(axis=1) + (xlogx(columns[c] + before) - xlogx(columns[c])).sum(axis=1)
            gain -= xlogx(out[:classes] + after.sum(axis=1)[:, None]) - xlogx(out[:classes]) + xlogx(into[:classes] + before.sum(axis=1)[:, None]) - xlogx(into[:classes])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gain.argmax(axis=1).astype(np.int32))], ["w", "class"])

    # the tasks' sums are dealt by word once, for both of the groupings
    dealt = texts.select(text).mapInArrow(neighbours, "w int, cell int, c long").repartition("w")
    lists = dealt.groupBy("w", "cell").agg(F.sum("c").alias("c")).groupBy("w").agg(F.collect_list("cell").alias("cells"), F.collect_list("c").alias("c"))
    got = lists.mapInArrow(assign, "w int, class int").toArrow()
    found = np.zeros(len(words), dtype=np.int64)
    found[got["w"].to_numpy()] = got["class"].to_numpy()
    return found[core:]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, fixed: list[int], classes: int, sweeps: int) -> np.ndarray:
    """The class of each row of ``bigrams``: rows in ``fixed`` have the last classes to themselves,
    the others move, one at a time and by falling count, to where the bigrams' likelihood is highest."""
    n = len(bigrams)
    b = bigrams.astype(np.float64)
    free = [w for w in np.argsort(-b.sum(axis=1), kind="stable") if w not in set(fixed)]
    k = classes + len(fixed)
    cls = np.zeros(n, dtype=np.int64)
    for i, w in enumerate(free):
        cls[w] = i % classes
    for i, w in enumerate(fixed):
        cls[w] = classes + i
    member = np.zeros((n, k))
    member[np.arange(n), cls] = 1
    grid = member.T @ b @ member
    out_w, in_w = b.sum(axis=1), b.sum(axis=0)
    out_c, in_c = member.T @ out_w, member.T @ in_w
    for _ in range(sweeps):
        moves = 0
        row_sums, col_sums = b @ member, member.T @ b
        for w in free:
            own = cls[w]
            r, q, s = row_sums[w].copy(), col_sums[:, w].copy(), b[w, w]
            grid[own] -= r
            grid[:, own] -= q
            grid[own, own] += s
            r[own] -= s
            q[own] -= s
            out_c[own] -= out_w[w]
            in_c[own] -= in_w[w]
            g = grid[:classes]
            gain = (xlogx(g + r) - xlogx(g)).sum(axis=1)
            gt = grid[:, :classes].T
            gain += (xlogx(gt + q) - xlogx(gt)).sum(axis=1)
            d = np.arange(classes)
            gd = grid[d, d]
            gain += xlogx(gd + r[d] + q[d] + s) + xlogx(gd) - xlogx(gd + r[d]) - xlogx(gd + q[d])
            gain -= xlogx(out_c[:classes] + out_w[w]) - xlogx(out_c[:classes]) + xlogx(in_c[:classes] + in_w[w]) - xlogx(in_c[:classes])
            new = int(np.argmax(gain))
            grid[new] += r
            grid[:, new] += q
            grid[new, new] += s
            out_c[new] += out_w[w]
            in_c[new] += in_w[w]
            if new != own:
                moves += 1
                cls[w] = new
                row_sums[:, own] -= b[:, w]
                row_sums[:, new] += b[:, w]
                col_sums[own] -= b[w]
                col_sums[new] += b[w]
                member[w, own], member[w, new] = 0, 1
        if not moves:
            break
    return cls


def train(texts: DataFrame, text: str = "text", core_words: int = 800, classes: int = 40, sweeps: int = 5, least_count: int = 3, frequent_words: int = 1 << 18, alpha: float = 5.0, discount: float = 0.5) -> Model:
    """A model of all rows of ``texts``."""
    counts = stored(word_counts(texts, text), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words, known = most_frequent(counts, frequent_words)
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, known = [END, *words], np.concatenate(([ends], known)).astype(np.float64)
    m = 1 + int((known[1:] >= least_count).sum())
    core = min(core_words + 1, m)
    bigrams = class_bigrams(texts, text, words[:core], np.arange(core + 1), core + 1)
    classes = max(1, min(classes, core - 1))
    cls = exchange(bigrams, [0, core], classes, sweeps)
    k = classes + 2
    member = np.zeros((core + 1, k))
    member[np.arange(core + 1), cls] = 1
    grid = member.T @ bigrams @ member
    if m > core:
        cls = np.concatenate((cls[:core], assign_classes(texts, text, words[:m], core, cls, grid, classes), cls[core:]))
        grid = class_bigrams(texts, text, words[:m], cls, k).astype(np.float64)
    share = (grid.sum(axis=0) + 1) / (grid.sum() + k)
    transition = (grid + alpha * share[None, :]) / (grid.sum(axis=1, keepdims=True) + alpha)
    class_counts = np.bincount(cls[:m], weights=known[:m], minlength=k)
    rest_total = int(total - known[:m].sum())
    return Model(counts, int(total), int(distinct), words, known, m, cls, np.log10(transition), class_counts, rest_total, int(distinct - (known[:m] > 0).sum()), discount)


def score_texts(df: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``n_tokens``, ``n_known`` (tokens that the training texts have), ``base_score``
    (add-one unigrams) and ``score``, log10 probabilities of the whole text, end included."""
    m, n = model.clustered, len(model.words)
    # one more place, at -1, for words outside the table: they count as the last class and are joined below
    cls = np.concatenate((model.word_class[:m], np.full(n - m + 1, model.word_class[m])))
    emit = np.zeros(n + 1)
    if m:
        emit[:m] = np.log10(np.maximum(model.word_counts[:m], 1e-9) / np.maximum(model.class_counts[cls[:m]], 1e-9))
        if model.word_counts[0] == 0:
            emit[0] = 0.0
    emit[m:n] = model.rest_log10(model.word_counts[m:])
    base = np.concatenate((model.base_log10(model.word_counts), [0.0]))
    table = {w: i for i, w in enumerate(model.words)}
    shared = df.sparkSession.sparkContext.broadcast((table, cls, emit, base, model.word_counts[0] > 0, model.transition))
    id_type = df.schema[id_column].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cls, emit, base, end_known, transition = shared.value
        get = table.get
        key = TaskContext.get().partitionId() << 36
        id_kind = None

        def rows(ids: list, firsts: list[int], keys: list[int], words: list[bytes], times: list[int], lengths: list[int], known: list[int], bases: list[float], scores: list[float]) -> pa.RecordBatch:
            n_rest = len(words)
            locals_ = [b" " + k.to_bytes(8, "big") for k in firsts]
            pad = lambda values, kind: pa.array([None] * n_rest + values, kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys + firsts, pa.int64()),
                    pa.array(words + locals_, pa.binary()),
                    pa.array(times + [None] * len(firsts), pa.int64()),
                    pad(ids, id_kind),
                    pad(lengths, pa.int64()),
                    pad(known, pa.int64()),
                    pad(bases, pa.float64()),
                    pad(scores, pa.float64()),
                ],
                ["key", "word", "times", "id", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch in batches:
            id_kind = batch.schema.field(0).type
            held: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(t)
                at = np.array([get(w, -1) for w in words] + [0], dtype=np.int64)
                path = cls[at]
                step = transition[np.concatenate((cls[:1], path[:-1])), path]
                rest = Counter([words[i] for i in np.flatnonzero(at < 0)])
                ids, firsts, keys, rest_words, times, lengths, known, bases, scores = held
                ids.append(doc_id)
                firsts.append(key)
                keys.extend([key] * len(rest))
                rest_words.extend(rest.keys())
                times.extend(rest.values())
                lengths.append(len(at))
                known.append(int((at > 0).sum()) + int(end_known))
                bases.append(float(base[at].sum()))
                scores.append(float(step.sum() + emit[at].sum()))
                key += 1
                if len(rest_words) > 1 << 17:
                    yield rows(*held)
                    held = ([], [], [], [], [], [], [], [], [])
            if held[0]:
                yield rows(*held)

    parts = df.select(id_column, text).mapInArrow(kernel, f"key long, word binary, times long, id {id_type}, n_tokens long, n_known long, base_score double, score double")
    counts = model.counts.select(F.col("word").alias("w"), "c")
    joined = parts.join(counts.hint("shuffle_hash"), F.col("word") == F.col("w"), "left")
    c, rest = F.coalesce(F.col("c"), F.lit(0)), F.col("times").isNotNull()
    joined = joined.select(
        "key",
        "id",
        "n_tokens",
        F.when(rest, F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(rest, F.col("times") * model.base_column(c)).otherwise(F.col("base_score")).alias("base_score"),
        F.when(rest, F.col("times") * model.rest_column(c)).otherwise(F.col("score")).alias("score"),
    )
    out = joined.groupBy("key").agg(F.max("id").alias(id_column), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return out.drop("key")
