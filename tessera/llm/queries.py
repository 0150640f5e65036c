"""The subpackage's queries: (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tessera.llm import audio, bpe, brown_lm, langid, ordinal, packing, quality_rules, simhash, urlfilter, warc
from tessera.llm.common import fold, read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to archives and read back."""
    out = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return out.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
        "error",
    )


OP1_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to,
  CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f USING (payload_digest)
"""

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels of hosts whose URLs make up the list of this query.
LISTED_LABELS = "ads-track|casino-win|spam-farm|adult-x|cheap-pills|free-bets"


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the list of all URLs of hosts with a listed label."""
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.where(urlfilter.url_host(F.col("url")).rlike(rf"(^|\.)({LISTED_LABELS})\.")).select("url")
    return urlfilter.filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


OP7_SQL = f"""
WITH a AS (
  SELECT page_id, url, contains(url, '://') AS ok,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
b AS (
  SELECT *, CASE WHEN ok THEN regexp_replace(regexp_replace(host, ':(?:80|443)$', ''), '^www\\.', '') || regexp_replace(regexp_replace(path, '/index\\.html$', ''), '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM a),
l AS (SELECT DISTINCT canonical FROM b WHERE regexp_matches(host, '(^|\\.)({LISTED_LABELS})\\.'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  canonical, coalesce(canonical IN (SELECT canonical FROM l), false) AS listed
FROM b
"""



def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled texts outside fold 0 of 5, predicts every text; a narrow
    margin is reported in ``rejected``, the prediction stays."""
    docs = read_table(spark, sf_dir, "documents")
    train = docs.where(fold("doc_id", 5) != 0).select("text", "lang")
    out = langid.identify_languages(docs.select("doc_id", "text"), train)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "margin", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in sequences of 1024 tokens."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text."""
    return quality_rules.repetition_rules(read_table(spark, sf_dir, "documents"))


def _op4_grams(n: int, which: str, what: str) -> str:
    """Words in windows of ``n`` whose ``which`` number in their text is over 1, counted as ``what``; words hold no spaces."""
    gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))])
    return f"""
g{n} AS (SELECT doc_id, i, {which} AS k FROM (SELECT doc_id, i, {gram} AS gram FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL),
c{n} AS (SELECT doc_id, {what} AS v FROM (SELECT DISTINCT doc_id, i + s AS i FROM g{n}, range({n}) t(s) WHERE k > 1) JOIN u USING (doc_id, i) GROUP BY doc_id),"""


_EARLIER = "row_number() OVER (PARTITION BY doc_id, gram ORDER BY i)"
OP4_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),"""
    + _op4_grams(3, "count(*) OVER (PARTITION BY doc_id, gram)", "count(*)")
    + "".join(_op4_grams(n, _EARLIER, "CAST(sum(length(word)) AS BIGINT)") for n in (5, 7, 10))
    + r"""
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]')),
dup AS (SELECT doc_id, count(*) AS n, CAST(sum(length(regexp_replace(line, '[ 	-
]', '', 'g'))) AS BIGINT) AS chars FROM l WHERE k > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(c3.v, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS dup_line_chars,
    coalesce(c5.v, 0) AS dup_5gram_chars, coalesce(c7.v, 0) AS dup_7gram_chars, coalesce(c10.v, 0) AS dup_10gram_chars
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN c3 ON w.doc_id = c3.doc_id LEFT JOIN c5 ON w.doc_id = c5.doc_id LEFT JOIN c7 ON w.doc_id = c7.doc_id LEFT JOIN c10 ON w.doc_id = c10.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= 0.3::DOUBLE * word_chars AND dup_5gram_chars <= 0.25::DOUBLE * word_chars
  AND dup_7gram_chars <= 0.22::DOUBLE * word_chars AND dup_10gram_chars <= 0.2::DOUBLE * word_chars AS kept
FROM f
"""
)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on labelled documents outside fold 0 of 5, grades every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = ordinal.grades_of(read_table(spark, sf_dir, "labels")).where(fold("doc_id", 5) != 0)
    out = ordinal.grade_texts(docs, ordinal.fit_classifier(docs, marks))
    return out.withColumnRenamed("selected", "kept").withColumn("held_out", fold("doc_id", 5) == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the components of links within 4 bits."""
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), words=4, size=1, max_bits=4)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the texts outside fold 2 of 7, scores every text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = brown_lm.train(docs.where(fold("doc_id", 7) != 2))
    out = brown_lm.score_texts(docs, model)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes that they decode to, as digests."""
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an 8-bit WAV clip, read back, with its features, their digest and the time spans.

    ``tensor`` has a fixed shape; :func:`audio.tensor_array` gives a column of it as Arrow tensors."""
    out = audio.audio_features(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_brown_lm": op6_brown_lm,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_audio": op9_audio,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op4_quality_rules": OP4_SQL, "op7_url_filter": OP7_SQL}
