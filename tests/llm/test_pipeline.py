"""The pipeline's stages on odd, empty and planted documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def prose(rng, words, vocabulary=400):
    lines, line = [], []
    for _ in range(words):
        line.append(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}")
        if len(line) == 12:
            lines.append(" ".join(line))
            line = []
    return "\n".join([*lines, " ".join(line)])


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        kind = i % 6
        text = prose(rng, rng.randrange(80, 400))
        if kind == 4:
            text = " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in text.split())
        if kind == 5:
            words = text.split()
            for k in range(0, len(words), 15):
                words[k] = rng.choice(["nasty", "vile", "rotten"])
            text = " ".join(words)
        rows.append((i, text, "xx", "s", len(text)))
        labels.append((i, 0 if kind == 4 else 1, 1 if kind == 5 else 0))
    copies = [(1000 + i, rows[0][1] if i else rows[0][1].replace("\n", " ", 1), "xx", "s", 1) for i in range(4)]
    repeated = [(2000, "the same few words come again and again " * 40, "xx", "s", 1)]
    odd = [(3000, None, None, None, None), (3001, "", "xx", "s", 0), (3002, "short", "xx", "s", 5), (None, prose(rng, 100), "xx", "s", 1)]
    where = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows + copies + repeated + odd, SCHEMA).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS).write.parquet(str(where / "labels.parquet"))
    return str(where)


def test_planted_documents(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, planted).cache()
        assert docs.schema.names == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        after.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i in range(240) if i % 6 < 4}
    assert not {i for i in range(240) if i % 6 == 5} & after[0]
    assert not {i for i in range(240) if i % 6 == 4} & after[0]
    assert len(clean - after[0]) <= 2
    assert 2000 not in after[1] and not {3000, 3001, 3002} & after[1]
    assert (clean & after[0]) <= after[1]
    assert not {1000, 1001, 1002, 1003} & after[2]
    assert (clean & after[1]) <= after[2]
    assert None in after[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, planted)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == after[2]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").withColumns({"fp": F.lit(1), "score": F.lit("x"), "selected": F.lit(None).cast("int")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns
        assert out.count() > 0
