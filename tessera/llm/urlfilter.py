"""URL filter: host/path rules first, then a list of canonical URLs.

The list is tested in two steps. A blocked Bloom filter (one 64-byte block per
URL, eight bits in it) passes every listed URL and few others; the rows that it
passes go to an exact hash join with the list, which removes the false
positives. A list that is counted small is broadcast, so rows are read once and never
shuffled; with a longer one the rows that pass are shuffled to it, and those that the
filter stops come from a second reading.

Edge cases: a null URL or one without ``://`` has an empty host and path, no
canonical form, no rule and the verdict ``allow``. Repeated rows are judged one
by one; an empty table or an empty list gives no listed row. Columns of the
input other than the URL pass through; ``host``, ``path``, ``rule``,
``canonical``, ``listed`` and ``verdict`` replace columns of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

BLOCK_BITS = 512
PROBES = 8
#: Query parameters that only track a visit.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without port 80/443 and without ``www.``, path without ``index.html`` or a
    last ``/``, and the query without tracking parameters; no scheme, no fragment.
    Null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/index\.html$", ""), r"/$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def with_rules(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", verdict_name: str = "rule_verdict") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and the rule's verdict.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains where
    the path starts with the rule's path; the longest host and path together wins,
    then the alphabetically first.
    """
    host_of, path_of = url_host(F.col(url)), url_path(F.col(url))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host_of == host) | host_of.endswith("." + host)) & path_of.startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumns({"host": host_of, "path": path_of, "rule": name, verdict_name: verdict})


def bit_picks(h: Column) -> list[Column]:
    """The eight bits of a hash in its block: six from the hash, two from hashes of it."""
    mask = F.lit(BLOCK_BITS - 1)
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(mask) for i in range(6)] + [F.xxhash64(h, F.lit(i)).bitwiseAND(mask) for i in range(PROBES - 6)]


def build_filter(listed: DataFrame, column: str, bits_per_url: int = 16, max_bytes: int = 1 << 25) -> np.ndarray:
    """Blocked Bloom filter of the distinct values: uint64 words, eight a block.

    The words are or-ed by block before and after the exchange, so the driver receives
    one row of eight words a block, ``max_bytes`` in all whatever the list's length; a
    list beyond ``max_bytes * 8 / bits_per_url`` only raises the share of false
    positives, which the exact join removes."""
    n = listed.count()
    blocks = max(1, min(max_bytes * 8, n * bits_per_url) // BLOCK_BITS)
    h = F.xxhash64(F.col(column))
    picks = listed.select(F.pmod(F.xxhash64(h), F.lit(blocks)).alias("block"), *[p.alias(f"b{i}") for i, p in enumerate(bit_picks(h))])

    def word(k: int) -> Column:
        masks = [F.when(F.shiftright(f"b{i}", 6) == k, F.expr(f"shiftleft(1L, cast(b{i} & 63 as int))")).otherwise(F.lit(0).cast("long")) for i in range(PROBES)]
        out = masks[0]
        for m in masks[1:]:
            out = out.bitwiseOR(m)
        return F.bit_or(out).alias(f"w{k}")

    rows = picks.groupBy("block").agg(*[word(k) for k in range(8)]).toArrow()
    words = np.zeros((blocks, 8), dtype=np.uint64)
    at = rows["block"].to_numpy()
    for k in range(8):
        words[at, k] = rows[f"w{k}"].to_numpy().view(np.uint64)
    return words.ravel()


def possibly_listed(df: DataFrame, column: str, words: np.ndarray) -> Column:
    """Column: false where the value is surely not listed."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    blocks = len(words) // 8

    @F.pandas_udf("boolean")
    def probe(h: pd.Series, block: pd.Series, more0: pd.Series, more1: pd.Series) -> pd.Series:
        known = h.notna().to_numpy()
        v = h.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)
        base = block.fillna(0).to_numpy(dtype=np.int64) * 8
        hit = known.copy()
        picks = [(v >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(6)]
        picks += [m.fillna(0).to_numpy(dtype=np.int64).view(np.uint64) & np.uint64(BLOCK_BITS - 1) for m in (more0, more1)]
        for bit in picks:
            word = shared.value[base + (bit >> np.uint64(6)).astype(np.int64)]
            hit &= (word >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(hit)

    h = F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))
    return probe(h, F.pmod(F.xxhash64(h), F.lit(blocks)), F.xxhash64(h, F.lit(0)), F.xxhash64(h, F.lit(1)))


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], listed: DataFrame, url: str = "url", default: str = "allow", broadcast_rows: int = 500_000) -> DataFrame:
    """Judges every row of ``df``.

    ``listed``: one string column of URLs in any form. Adds ``host``, ``path``,
    ``canonical``, ``rule`` (null where none fits), ``listed`` and ``verdict``: the
    rule's, else ``block`` for a listed URL, else ``default``.
    """
    mark, possible, ruled = (f"__{uuid.uuid4().hex}" for _ in range(3))
    name = listed.columns[0]
    listed = listed.select(canonical_url(F.col(name)).alias(mark)).where(F.col(mark).isNotNull())
    listed = cut(listed.distinct())
    words = build_filter(listed, mark)
    url_column = f"__{uuid.uuid4().hex}"
    judged = with_rules(df.withColumn(url_column, F.col(url)), rules, url_column, ruled).withColumn("canonical", canonical_url(F.col(url_column))).drop(url_column)
    judged = judged.withColumn(possible, possibly_listed(judged, "canonical", words))
    if listed.count() <= broadcast_rows:
        out = judged.join(F.broadcast(listed), F.col(possible) & (F.col("canonical") == F.col(mark)), "left").withColumn("listed", F.col(mark).isNotNull()).drop(mark)
    else:
        exact = judged.where(F.col(possible)).join(listed.hint("shuffle_hash"), F.col("canonical") == F.col(mark), "left").withColumn("listed", F.col(mark).isNotNull()).drop(mark)
        out = judged.where(~F.col(possible)).withColumn("listed", F.lit(False)).unionByName(exact)
    verdict = F.coalesce(F.col(ruled), F.when(F.col("listed"), "block").otherwise(F.lit(default)))
    return out.withColumn("verdict", verdict).drop(possible, ruled)
