"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns what
it keeps; all but the last return the columns of ``documents``.

Edge cases, the same in every stage: a null or empty text has no words, so the quality
rules drop it if the classifier hasn't; texts of any length are worked on whole; ties are
broken by the id (the least of a group of near-duplicates stays, equal lengths are packed in
any order); repeated rows are judged one by one, and rows that repeat an id share its
near-duplicate decision; rows without an id are never near-duplicates of others; extra
columns pass through all stages but the last; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ordinal, packing, quality_rules, simhash
from tessera.llm.common import WORK, discard, read_table, work_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half."""
    marks = ordinal.grades_of(read_table(spark, sf_dir, "labels"))
    return ordinal.keep_texts(docs, ordinal.fit_classifier(docs, marks))


def repetition(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_texts(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", repetition),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", best_fit),
]

#: SQL can express neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage read or left in the shared folder is removed once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    others = set(WORK)
    for name, stage in STAGES:
        where = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        discard(spark, others | {where})
    return docs
