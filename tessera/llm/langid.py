"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of sample texts. A text is
reduced to its letters (lower case, everything else one space) and compressed in
blocks with each dictionary; the language whose blocks are smallest in total wins. A
narrow margin to the second is a rejection. Sizes are whole bytes and each frame has
some bytes of its own, which is most of what a text of a few words compresses to: alone,
all languages tie. So a text of less than ``SHORT`` bytes is compressed behind more sample
text of the language, and that text's own size is subtracted. For longer texts that
context would cost time and tell nothing more, and they fill blocks by themselves.

Edge cases: a null text or one without a letter is ``und`` with score 0; texts of any
length are compressed whole, block by block; ties go to the alphabetically first
language; without any labelled text every row is ``und``. Input columns other than
the id and the text aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}]+")
#: Texts of fewer bytes are compressed behind a context.
SHORT = 300


def letters(text: str) -> bytes:
    """What is compressed of a text."""
    return OTHER.sub(" ", text).lower().encode()


SCHEMA = "lang_pred string, lang_best string, score double, margin double, rejected boolean"


def sample_texts(train: DataFrame, text: str, lang: str, rows_per_lang: int) -> dict[str, bytes]:
    """Sample bytes of every language that has a labelled text with a letter.

    A bounded sample: ``rows_per_lang`` different texts of each language at most, those
    with the least hashes, each of them whole."""
    key = F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1 << 30))
    usable = train.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t")).withColumn("k", key)
    # about four times as many pass by their hash, so the window below has few rows a language
    bound = usable.groupBy("l").agg(F.approx_count_distinct("k").alias("n")).select("l", (4.0 * rows_per_lang * (1 << 30) / F.col("n")).alias("below"))
    near = usable.join(F.broadcast(bound), "l").where(F.col("k") < F.col("below")).select("l", "k", "t").distinct()
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("k", "t"))).where(F.col("r") <= rows_per_lang)
    parts: dict[str, list[bytes]] = {}
    for name, t in first.orderBy("l", "r").select("l", "t").collect():
        parts.setdefault(name, []).append(letters(t))
    return {name: b" ".join(x) for name, x in parts.items()}


class Packer:
    """One language's compressor: a digested dictionary, and a context for short texts."""

    def __init__(self, sample: bytes, context_bytes: int):
        context_bytes = min(context_bytes, len(sample) // 4)
        cut = len(sample) - context_bytes
        reach = max(18, min(27, (len(sample) + 4096).bit_length()))
        options = zstd.ZstdCompressionParameters(window_log=reach, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=zstd.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)
        shared = zstd.ZstdCompressionDict(sample[:cut], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=options)
        self.tool = zstd.ZstdCompressor(dict_data=shared, compression_params=options)
        self.context = sample[cut:] + b" "
        self.context_size = len(self.tool.compress(self.context))

    def size(self, data: bytes, block: int) -> int:
        if len(data) < SHORT:
            return len(self.tool.compress(self.context + data)) - self.context_size
        view = memoryview(data)
        return sum(len(self.tool.compress(view[i : i + block])) for i in range(0, len(view), block))


def predict_languages(df: DataFrame, samples: dict[str, bytes], id_column: str = "doc_id", text: str = "text", block: int = 2048, context_bytes: int = 1500, min_margin: float = 0.01, min_score: float = 0.2) -> DataFrame:
    """The id and, for each row: ``lang_best``, ``margin`` (by how much of its size the
    second is larger), ``score`` (0 to 1, by the bytes between the two), ``rejected`` and ``lang_pred`` (``und`` if rejected)."""
    names = list(samples)
    id_type = df.schema[id_column].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [Packer(x, context_bytes) for x in samples.values()]
        for batch in batches:
            best, margins, scores = [], [], []
            for t in batch.column(1).to_pylist():
                if not t or not names or not LETTER.search(t):
                    best.append(None)
                    margins.append(0.0)
                    scores.append(0.0)
                    continue
                data = letters(t)
                sizes = np.maximum(1.0, [c.size(data, block) for c in compressors])
                order = np.argsort(sizes, kind="stable")
                first = sizes[order[0]]
                margin = float(sizes[order[1]] / first - 1) if len(order) > 1 else 1.0
                best.append(names[order[0]])
                margins.append(margin)
                gain = float(sizes[order[1]] - first) if len(order) > 1 else float(len(data))
                scores.append(float(1 - np.exp(-gain / 8)))
            narrow = [b is None or m < min_margin or s < min_score for b, m, s in zip(best, margins, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(["und" if r else b for b, r in zip(best, narrow, strict=True)], pa.string()), pa.array([b or "und" for b in best], pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(narrow, pa.bool_())],
                [id_column, "lang_pred", "lang_best", "score", "margin", "rejected"],
            )

    return df.select(id_column, text).mapInArrow(kernel, f"{id_column} {id_type}, {SCHEMA}")


def identify_languages(df: DataFrame, train: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 100, **options: object) -> DataFrame:
    """:func:`sample_texts` of ``train``, then :func:`predict_languages` of ``df``."""
    return predict_languages(df, sample_texts(train, text, lang, rows_per_lang), id_column, text, **options)
