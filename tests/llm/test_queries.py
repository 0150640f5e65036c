"""The subpackage's queries: against SQL where there is some, else against brute force, on the small tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import audio, bpe, queries, simhash
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])


def test_op2_held_out_accuracy(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op2_language_id").merge(docs, on="doc_id")
    assert len(out) == len(docs)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all()
    assert (out.lang_pred == out.lang)[out.held_out].mean() > 0.9


def test_op3_pieces(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op3_packing")
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert set(out.doc_id) == set(ids)
    for doc_id, pieces in out.sort_values("piece").groupby("doc_id"):
        at = 0
        for k, r in enumerate(pieces.itertuples()):
            assert (r.piece, r.start) == (k, at)
            assert r.length == 1024 or k == 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc_id][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[doc_id])
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert (rows.offset == rows.length.cumsum().shift(fill_value=0)).all()
        assert rows.length.sum() <= 1024
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 1024) * 1.01 + 1


def test_op5_components(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op5_simhash").set_index("doc_id")
    fp = {i: simhash.fingerprint(t, 4)[0] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([fp[i] for i in ids])
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 4):
            a, b = sorted((find(i), find(ids[k + 1 + j])))
            root[b] = a
    assert {i: find(i) for i in ids} == out.component_id.to_dict()
    assert {i: f"{int(v):016x}" for i, v in fp.items()} == out.fingerprint.to_dict()


def test_op6_base_and_score(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op6_brown_lm").set_index("doc_id")
    texts = {i: [*(t or "").encode().lower().split(), b""] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, words in texts.items():
        r = out.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in counts for w in words), n, held[i])
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    mine = out[out.held_out]
    assert mine.score.sum() > mine.base_score.sum()


def test_op8_as_the_library(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op8_byte_bpe").set_index("doc_id")
    ranks = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode_ordinary(t or "")
        assert out.loc[i].n_tokens == len(ids)
        assert out.loc[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out.loc[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_op9_round_trip(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op9_audio").set_index("doc_id")
    by_text = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = out.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
        wav = audio.encode_wav(padded)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert by_text.setdefault(t, r.feature) == r.feature


def test_op10_held_out(spark, sf_dir):
    out = run(spark, sf_dir.replace("sf0.001", "sf0.1"), "op10_quality_classifier").merge(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert held[(held.quality == 1) & (held.toxic == 0)].kept.mean() > 0.97
    assert held[held.toxic == 1].kept.mean() < 0.1
    assert held[(held.quality == 0) & (held.toxic == 0)].kept.mean() < 0.15


def test_pipeline_runs_every_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
